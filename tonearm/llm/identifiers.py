"""Labelled samples of ordinary identifiers: fixed words of four languages, put together as code, paths and prose do."""

from __future__ import annotations

import random

#: Fixed values.
WORDS = """
access account action active actual add address after again agent align alert allow amount annotation answer api append application apply archive
area argument array article assert assign async attribute audio author available average background backup balance bank base batch before begin
behavior best binary block board body book border bottom branch bridge broker browser bucket buffer build bulk button byte cache calendar call
cancel capacity card category center certificate chain change channel character charge check child choice city class clean clear client clock close
cloud cluster code collection color column command comment commit common community company compare compile complete component compress compute
condition config configuration connect connection console constraint contact container content context control convert cookie copy core cost count
country create credit current cursor custom customer cycle daily data database date day debug decode default delete deliver demand density deploy
description design detail develop device dictionary different digest direction directory disable discount display distance document domain double
download draft drive driver duration dynamic early edge edit education element email empty enable encode encryption engine english entity entry
environment error evaluate event every exact example exception exchange execute exist expect export express extension external factory failure
family feature feedback field file filter final finance find first flag float folder follow format forward foundation frame free frequency from
front full function future garden gateway general generate global government graph green group growth handler hardware header health height help
hidden history holder home host hour house http image import income index industry information initial input insert instance integer interface
international internationalisation internal interval inventory invoice item iterator java job journal json junction just keep kernel key keyboard
keyword kind knowledge label language large last latest launch layer layout leader learn left length level library license light limit line link
list load local location lock log login long lookup loop machine mail main manager manual map market master match matrix maximum measure media
member memory menu merge message method metric middle migration minimum minute mobile mode model module monitor month movie multiple music name
native navigation network never node normal notification number object offset online open operation optimize option order organization original
output overview owner package page panel parallel parameter parent parser partition password path pattern payment pending people percent performance
period permission person phone picture pipeline place plan platform player plugin point policy pool popular port position power prefix present
preview price primary print priority private problem process product profile program progress project property protocol provider proxy public
publish purchase quality quantity query question queue quick quote random range rate reader ready real reason receive recent recommend record
recover redirect reference refresh region register registry relation release remember remote remove render repeat replace report repository request
require reset resource response restore result retry return revenue review right role root route rule runtime safe sample save scale schedule schema
scope score screen script search season second section security segment select sender sequence series server service session setting shape share
shipping short signal simple single size snapshot social software sort source space special speed stack staging standard start state static
statistic status step stock storage store stream string structure student style subject submit success suffix summary supplier support switch symbol
sync system table target task team template tenant terminal test text theme thing thread threshold time timeout title token tool total trace track
traffic transaction transfer transform translate transport tree trigger tuple type unique unit universal unknown update upgrade upload user utility
validate value variable vector vendor version video view visible volume wait warehouse warning watch weather website week weight width window
wizard word work worker workflow world wrapper write year yellow young zero zone
the and that have with this they which would there their about what other these into could than then only over such through where between
because should against everywhere another something nothing without within whether although however therefore being having thinking running
abteilung absatz aenderung anfang angebot anmeldung antwort anzahl arbeit aufgabe auftrag ausgabe auswahl bearbeitung bedeutung beispiel benutzer
bereich bericht bestellung betrag bewertung beziehung daten datei dauer eigenschaft eingabe einheit einstellung entwicklung ergebnis erfahrung
erklaerung fehler fenster forschung freiheit funktion gebiet gemeinschaft geschichte geschwindigkeit gesellschaft gesundheit gewinn grenze grundlage
haushalt herstellung hilfe inhalt jahr kapitel kenntnis kirche klasse konto kraft krankheit kunde laenge landschaft lehrer leistung lieferung
loesung menge mensch mitglied moeglichkeit nachricht nummer oberflaeche ordnung pflicht platz preis pruefung quelle rechnung regierung reihenfolge
richtung schluessel schnittstelle schreiben schule schutz seite sicherheit speicher sprache staat stadt stimme strasse stunde suche tabelle teil
uebersicht umgebung unterschied unternehmen ursprung verbindung verfahren vergleich verhalten verkauf verlauf versicherung vertrag verwaltung
verzeichnis vorgang vorschlag wahrheit wechsel wirtschaft wissenschaft wohnung zahlung zeichen zeit zeitraum zugriff zukunft zusammenfassung zustand
und oder nicht auch eine einen einer werden wurde haben sein durch ueber unter zwischen gegen keine mehr sehr schon immer pfad pfeil
abonnement acheteur actualite adresse affichage agence ajouter analyse annee appareil application assurance auteur avantage banque bateau besoin
bibliotheque bureau cadeau campagne capacite chaine chambre champ chapitre chemin cheveux choix chose clavier client commande commentaire compagnie
comportement compte connaissance conseil consommateur courant creation decision delai demande departement developpement difference donnees droit
ecole ecriture element emploi enfant enquete ensemble entreprise environnement erreur espace essai etage evenement exemple facture famille fenetre
fichier finance fonction formation francais gestion gouvernement groupe habitude heureux histoire hopital image information journal jeunesse langue
lecture lettre ligne liste livre logiciel longueur lumiere magasin maison malheureusement marque mesure metier monde montant morceau moteur mouvement
musique naissance niveau nombre nouveau numero objet oeuvre oiseau ouverture page paiement parole passage peuple place plateforme population pouvoir
prix probleme produit programme projet qualite quantite quelque question quotidien raison rapport recherche region reponse reseau resultat retour
reunion semaine service signature societe soleil sommaire source stockage suivant sujet tableau tache taille tel travail utilisateur valeur vendeur
vente verification ville visage voiture voyage avec dans pour cette mais nous vous leur elle aussi entre toujours lequel laquelle monsieur
actividad actualmente administrador agua ajuste alcance almacen ambiente amigo archivo ayuda barrio biblioteca bienvenida busqueda cabeza calidad
calle camino cantidad capitulo carpeta casa categoria ciencia ciudad clave cliente codigo compra computadora comunidad conjunto conocimiento consulta
contenido contrato correo cuenta cultura decision derecho desarrollo descripcion direccion diseno documento edad educacion ejemplo empresa encuesta
entrada entrega equipo error escritura escuela espacio estado estudio experiencia fabrica factura familia fecha fuente funcion ganancia gobierno
grupo herramienta historia hombre iglesia imagen indice informacion ingreso inicio juego jugador lectura lengua lentamente libro limite linea lista
llave lugar maestro mercado mensaje mujer mundo naturaleza negocio nombre numero objeto operacion ordenador pagina palabra pantalla pedido pelicula
periodico persona pregunta presupuesto principio problema proceso producto programa propiedad prueba pueblo rapidamente recurso red registro relacion
respuesta resultado reunion revista salida salud seguridad semana servicio siguiente sistema sociedad solicitud tamano tarea tarjeta tiempo tienda
titulo trabajo usuario valor vecino ventana verdad viaje vivienda para como este esta pero sobre entre cuando desde hasta tambien nosotros
""".split()
ENDINGS = {
    "en": "tion ing ment ness able ible less ful ly er ers est ed ation ity ive ous ent ence ance ism ist ship hood ward wise".split(),
    "de": "ung ungen heit keit lich lichen schaft isch ischen bar sam los ver ent er be ge zer ein aus auf vor ab".split(),
    "fr": "tion ment ement eur euse eaux eau elle elles aire oire ique iere esse age ance ou que es aient".split(),
    "es": "cion ciones mente ado ada ados idad oso osa ero era ito ita illo illa ando iendo aba aron que los las".split(),
}
STYLES = ("snake", "screaming", "camel", "pascal", "kebab", "path", "assigned", "joined", "derived", "dated", "numbered", "digits", "line")
SAMPLES = 24_000


def _digits(draw: random.Random) -> str:
    date = f"{draw.randint(1970, 2039)}{draw.randint(1, 12):02d}{draw.randint(1, 28):02d}"
    clock = f"{draw.randint(0, 23):02d}{draw.randint(0, 59):02d}{draw.randint(0, 59):02d}"
    return draw.choice((date + clock, date + clock + f"{draw.randint(0, 999999):06d}", f"{draw.randint(0, 10**12)}", "0" * draw.randint(4, 24), f"{draw.randint(1, 9999):020d}"))


def _line(draw: random.Random) -> str:
    """A rule under a heading, or the frame of a table."""
    if draw.random() < 0.5:
        return draw.choice("=-_/+") * draw.randint(4, 80)
    return "+" + "+".join(draw.choice("-=") * draw.randint(2, 30) for _ in range(draw.randint(1, 6))) + "+"


def ordinary(seed: int = 31) -> list[str]:
    """The labelled identifiers, no two alike; the same list in every run."""
    draw, found = random.Random(seed), {}
    endings = list(ENDINGS.values())
    for i in range(SAMPLES):
        style = STYLES[i % len(STYLES)]
        words = [draw.choice(WORDS) for _ in range(draw.randint(2, 5))]
        big = [w.capitalize() for w in words]
        year = f"{draw.randint(1990, 2035)}"
        found[
            {
                "snake": lambda: "_".join(words),
                "screaming": lambda: "_".join(words).upper(),
                "camel": lambda: words[0] + "".join(big[1:]),
                "pascal": lambda: "".join(big),
                "kebab": lambda: "-".join(words),
                "path": lambda: draw.choice(("/", "")) + "/".join(words),
                "assigned": lambda: "_".join(words[:-1]) + "=" + words[-1],
                "joined": lambda: "".join(words[:3]),
                "derived": lambda: words[0] + "".join(draw.choice(e) for e in [draw.choice(endings)] for _ in range(draw.randint(1, 4))),
                "dated": lambda: "-".join([*words[:2], year, f"{draw.randint(1, 12):02d}", f"{draw.randint(1, 28):02d}"]),
                "numbered": lambda: draw.choice(("_", "-", "/", "")).join([words[0], f"{words[1]}{draw.randint(0, 99)}", *words[2:], f"v{draw.randint(1, 12)}"]),
                "digits": lambda: _digits(draw),
                "line": lambda: _line(draw),
            }[style]()
        ] = None
    return list(found)

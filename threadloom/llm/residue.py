"""Template residue, filler, error pages and script notices in place of a mail's content (problem 10).

Character n-gram models of filler, notices and unfilled fields are fitted on the phrases below, the one of natural prose
on all documents. A class's model is mixed with that of prose, so that a wording it never met costs little and one it
shares with prose tells nothing. The log likelihood ratio of each class against prose, averaged over a window, localises
residue. A document is excluded if filler and notices cover most of it, or if a window of an unfilled field holds a whole
delimited field and the rest of its line isn't talk about templates (by the same kind of ratio).
"""

from http import HTTPStatus
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.sources.tables import spread

# Filler.
FILLER = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
aliqua elit minim labore lorem adipiscing lorem quis velit minim labore aliqua magna tempor amet sed nulla ipsum dolor
asdf asdf
asdf jkl asdf
qwerty qwerty
blah blah blah
blah blah
test test test
foo bar baz
xxx xxx xxx
tbd
to be written
to be done
your text here
enter description
enter text here
insert text here
sample paragraph
sample text
headline goes here
title goes here
text goes here
dummy copy for layout only
dummy text
placeholder text
texte de remplissage
paragraphe d'exemple
texte factice pour la maquette
essai essai
à rédiger
votre texte ici
texte à venir
titre à venir
texto de relleno
su texto aquí
texto de ejemplo
párrafo de muestra
título provisional
escriba aquí su texto
pendiente de redactar
prueba prueba
blindtext
hier steht ein text
ihr text hier
platzhaltertext
beispielabsatz
hier steht ihr text
noch zu schreiben
bla bla
Überschrift folgt
nur ein Blindtext für das Layout
"""
# Error pages and what stands around them, and notices that scripts are required.
NOTICES = """
Error 404 - Not Found
Error 410 - Gone
Error 500: Internal Server Error
Error 503 - Service Unavailable
HTTP ERROR 403
HTTP/1.1 502 Bad Gateway
HTTP/1.1 504 Gateway Timeout
HTTP/1.1 429 Too Many Requests
Status 401 (Unauthorized)
Status 400 (Bad Request)
Status 403 (Forbidden)
404 | Not Found
410 Gone
500 Internal Server Error
502 Bad Gateway
503 Service Temporarily Unavailable
504 Gateway Timeout
429 Too Many Requests
400 Bad Request
Request ID: 62f12-62
Traceback id 1612, contact the webmaster
velhttpd/2.28 Server at archive.example Port 80
Reference #39.33
nox/1.25
Code: 500
Go back | Home | Search
Retour à l'accueil
Volver
Zurück
Back
the archive is down for maintenance, come back later.
this site is under construction
this message is no longer in the archive.
too many requests. slow down.
the page you requested could not be found.
the page could not be found.
the address you asked for could not be found!
the address you asked for is restricted to members.
the resource cannot be displayed
the resource could not be found.
the archive could not be found
the message failed to load
the message is no longer available
the list is restricted to members
the server encountered an error
oops! something went wrong.
access denied
database connection failed
your session has expired, log in again.
accès refusé
erreur interne du serveur
Erreur 404 : page introuvable
la page est introuvable!
la page demandée n'existe plus.
la page n'est plus disponible!
le service est momentanément indisponible.
archive en maintenance, revenez plus tard.
votre session a expiré.
zugriff verweigert
interner serverfehler
Fehler 404 – Seite nicht gefunden
die Seite wurde nicht gefunden
die seite ist gesperrt.
die seite ist nicht mehr verfügbar
der Dienst ist vorübergehend nicht verfügbar.
archiv wird gewartet
ihre sitzung ist abgelaufen.
Error 404: página no encontrada
la página no se encuentra
la página ya no existe
error interno del servidor
acceso denegado
servicio no disponible temporalmente.
sitio en mantenimiento
su sesión ha caducado.
aide-bureau archive
Please enable JavaScript to view the archive.
This viewer does not work without JavaScript.
This archive relies on scripts.
This archive relies on active scripting.
JavaScript must be switched on to read this list.
script support must be switched on to read this list.
Sorry, no content without script support.
To see the thread, enable active scripting.
You need to turn on scripts to use this page.
Your browser has scripting disabled.
We noticed that JavaScript is off in your browser; turn it on and reload.
Checking your browser before access... scripts and cookies are required.
Allow JavaScript for archive.example to continue.
JS must be switched on to read this list.
Sorry, no content without JS.
noscript: content cannot be displayed
Votre navigateur bloque JavaScript.
Activez les cookies et les scripts puis rechargez.
Les scripts sont nécessaires à l'affichage de l'archive.
Contenu indisponible sans l'exécution de scripts.
Pour lire la discussion, activez JavaScript.
Veuillez activer JavaScript pour lire cette page.
Autorisez l'exécution de scripts puis rechargez la page.
Cette archive a besoin de JavaScript.
Contenu indisponible sans les scripts.
Bitte aktivieren Sie JavaScript.
Erlauben Sie JavaScript und laden Sie neu.
Dieses Archiv benötigt JavaScript.
Ihr Browser hat Skripte deaktiviert.
Ihr Browser unterstützt keine Skripte.
Erlauben Sie aktive Inhalte und laden Sie neu.
Zum Lesen der Liste aktive Inhalte einschalten.
Ohne Skripte kann dieses Archiv nicht angezeigt werden.
Ohne Skripte kann nichts angezeigt werden.
Zum Lesen der Liste JavaScript einschalten.
Kein Inhalt ohne Skripte.
Skriptausführung erforderlich.
Su navegador tiene los scripts desactivados.
Esta página necesita scripts para funcionar.
Este archivo requiere la ejecución de scripts.
Active JavaScript para ver el archivo.
Permita la ejecución de scripts y recargue.
Para leer la lista, habilite JavaScript.
Sin la ejecución de scripts no hay contenido.
"""
# What error pages speak of, and what they say of it; each pair makes a phrase.
PAGES = [
    (
        ["the page", "the message", "the thread", "the list", "the resource", "the archive", "the attachment", "the address you asked for", "the page you requested"],
        ["could not be found.", "cannot be displayed.", "failed to load.", "does not exist any more.", "has moved or was removed!", "is not available right now.", "is restricted to members."],
    ),
    (
        ["la page", "la page demandée", "la discussion", "la liste", "la ressource", "la pièce jointe", "la archive demandée", "l'adresse demandée", "le message"],
        ["est introuvable.", "n'existe plus.", "n'est plus disponible.", "ne peut être affichée.", "a été déplacée ou supprimée.", "est réservée aux abonnés.", "n'a pas pu être chargée."],
    ),
    (
        ["la página", "la conversación", "la lista", "el mensaje", "el recurso", "el archivo", "la dirección solicitada", "el adjunto"],
        ["no se encuentra.", "ya no existe.", "ya no está disponible.", "no se puede mostrar.", "se ha movido o eliminado.", "es solo para suscriptores.", "no se pudo cargar."],
    ),
    (
        ["die Seite", "die Nachricht", "die Liste", "die Ressource", "das Archiv", "der Anhang", "die angeforderte Adresse", "die Diskussion"],
        ["ist gesperrt.", "wurde nicht gefunden.", "ist zurzeit nicht erreichbar.", "existiert nicht mehr.", "kann nicht angezeigt werden.", "wurde verschoben oder gelöscht.", "ist nur für Mitglieder."],
    ),
]
# Wordings of error pages and notices in general use, each list of beginnings with each of ends.
GENERAL = [
    (["Sorry,", "We're sorry,", "Oops,", "Oh no,"], ["something went wrong on our end.", "there was a problem.", "we can't find that page.", "the page you requested is not here any more.", "this content isn't available right now."]),
    (["An unexpected error", "An internal error", "A fatal error", "An error", "A problem"], ["has occurred.", "occurred while processing your request.", "occurred. Please try again later.", "prevented the page from loading."]),
    (["The server", "The website", "The service", "The application", "This site"], ["is temporarily unavailable.", "is overloaded.", "did not respond in time.", "took too long to respond.", "is down for maintenance.", "is currently unable to handle the request.", "encountered an unexpected condition.", "cannot be reached."]),
    (["You do not have", "You don't have", "You need", "You lack"], ["permission to view this page.", "the required permission.", "access to this resource on this server.", "to be logged in to view this page."]),
    (["Please", "You can", "Kindly"], ["try again later.", "try again in a few minutes.", "contact the administrator.", "contact support if the problem persists.", "check the address and try again.", "reload the page.", "refresh the page.", "go back to the home page.", "sign in again to continue."]),
    (["The connection", "Your connection", "The request", "Your request", "The session", "Your account"], ["was reset.", "was refused.", "timed out.", "has timed out.", "has been blocked.", "has been suspended.", "was denied.", "could not be completed.", "could not be processed.", "has expired."]),
    (["Could not connect", "Failed to connect", "Cannot connect", "Error connecting"], ["to the database.", "to the server.", "to the database server."]),
    (["Cette page", "La page que vous cherchez", "Ce contenu", "Ce site", "Le lien que vous avez suivi"], ["n'existe pas ou plus.", "est inaccessible pour le moment.", "est momentanément indisponible.", "a expiré.", "ne répond pas.", "est invalide ou rompu.", "a peut-être été déplacé."]),
    (["Une erreur", "Une erreur inattendue", "Une erreur interne", "Un problème"], ["s'est produite.", "est survenue.", "est survenu pendant le traitement de la demande.", "empêche l'affichage de la page."]),
    (["Veuillez", "Merci de"], ["réessayer plus tard.", "réessayer dans quelques instants.", "contacter l'administrateur du site.", "recharger la page.", "vous reconnecter.", "vérifier l'adresse."]),
    (["Vous n'avez pas", "Vous n'avez plus"], ["le droit d'accéder à ce document.", "les droits nécessaires.", "accès à cette ressource.", "l'autorisation de voir ce contenu."]),
    (["Le serveur", "Le service", "La connexion", "La requête"], ["a refusé la connexion.", "ne répond pas.", "a expiré.", "met trop de temps à répondre.", "est surchargé.", "a été interrompue.", "est en maintenance."]),
    (["Diese Seite", "Die gesuchte Seite", "Die aufgerufene Seite", "Dieser Inhalt", "Diese Website"], ["existiert nicht.", "existiert nicht mehr.", "konnte nicht gefunden werden.", "wurde leider nicht gefunden.", "ist derzeit nicht verfügbar.", "ist nicht erreichbar.", "wurde gelöscht."]),
    (["Es ist ein unerwarteter Fehler", "Leider ist ein Fehler", "Ein interner Fehler ist", "Beim Laden der Seite ist ein Fehler"], ["aufgetreten."]),
    (["Bitte versuchen Sie es", "Versuchen Sie es bitte", "Bitte probieren Sie es"], ["später noch einmal.", "in einigen Minuten erneut.", "zu einem späteren Zeitpunkt."]),
    (["Sie haben keinen Zugriff", "Sie haben keine Berechtigung", "Ihnen fehlt die Berechtigung"], ["auf diese Seite.", "für diesen Bereich.", "um diesen Inhalt zu sehen.", "zum Aufruf dieser Adresse."]),
    (["Der Server", "Der Dienst", "Die Verbindung", "Die Anfrage"], ["antwortet nicht.", "ist überlastet.", "wurde unterbrochen.", "wurde abgelehnt.", "konnte nicht verarbeitet werden.", "hat zu lange gedauert.", "wird gerade gewartet."]),
    (["Esta página", "La página que buscas", "La página solicitada", "Este contenido", "Este sitio web"], ["no existe.", "no está disponible.", "no se ha encontrado.", "no se encuentra disponible en este momento.", "ha sido eliminada.", "ha cambiado de dirección."]),
    (["Ha ocurrido", "Se produjo", "Lo sentimos, ha habido"], ["un error.", "un error interno.", "un error al procesar la solicitud.", "un problema."]),
    (["Por favor, inténtelo", "Vuelva a intentarlo", "Inténtalo de nuevo"], ["más tarde.", "en unos minutos.", "dentro de un rato."]),
    (["No tiene", "No dispone de", "Usted no tiene"], ["acceso a esta página.", "autorización para ver este contenido.", "los permisos necesarios.", "permisos para acceder a este recurso."]),
    (["El servidor", "El servicio", "La conexión", "La solicitud"], ["no responde.", "está sobrecargado.", "ha caducado.", "ha sido rechazada.", "tardó demasiado en responder.", "está en mantenimiento."]),
    (["Please enable", "Please turn on", "Turn on", "You must enable", "Switch on", "Activate"], ["JavaScript in your browser.", "JavaScript to view this page.", "JavaScript to continue.", "scripts in the settings of your browser.", "JavaScript and reload the page.", "cookies and scripts to proceed."]),
    (["This page", "This app", "This application", "The full version of this site", "Our site"], ["requires JavaScript.", "needs JavaScript to work.", "works best with scripts enabled.", "cannot be shown while scripts are blocked.", "will not work without JavaScript."]),
    (["JavaScript", "Scripting", "Script execution"], ["is disabled.", "is turned off in your browser.", "is not enabled.", "is blocked by your browser.", "is required.", "is not supported by this browser."]),
    (["Veuillez autoriser", "Il faut activer", "Pensez à activer", "Vous devez autoriser"], ["JavaScript dans les réglages de votre navigateur.", "JavaScript pour continuer.", "les scripts pour voir ce contenu.", "l'exécution des scripts."]),
    (["Cette page", "Cette application", "Notre site", "L'affichage de la page"], ["requiert JavaScript.", "a besoin des scripts.", "ne fonctionne pas sans JavaScript.", "exige l'activation de JavaScript."]),
    (["JavaScript"], ["n'est pas activé.", "est bloqué par votre navigateur.", "est inactif.", "doit être activé.", "wird benötigt.", "ist ausgeschaltet.", "ist nicht aktiviert.", "muss eingeschaltet sein.", "está desactivado.", "no está habilitado.", "es necesario.", "debe estar activado."]),
    (["Bitte schalten Sie", "Bitte aktivieren Sie", "Sie müssen", "Aktivieren Sie"], ["JavaScript in Ihrem Browser ein.", "JavaScript, um fortzufahren.", "Skripte in den Einstellungen erlauben.", "JavaScript aktivieren, um diese Seite zu nutzen."]),
    (["Diese Seite", "Diese Webseite", "Die Anwendung", "Dieser Dienst"], ["erfordert JavaScript.", "setzt JavaScript voraus.", "funktioniert nur mit aktiviertem JavaScript.", "läuft nicht ohne Skripte."]),
    (["Debe habilitar", "Es necesario activar", "Tienes que activar", "Habilite"], ["JavaScript en tu navegador.", "JavaScript para ver este contenido.", "JavaScript para usar este servicio.", "los scripts para seguir."]),
    (["Esta aplicación", "Esta web", "El sitio", "Esta página"], ["necesita JavaScript.", "requiere tener JavaScript activado.", "no funciona sin JavaScript.", "usa scripts que su navegador bloquea."]),
]
# Wordings of filler in general use, likewise, and the passages it is commonly drawn from.
STOPGAPS = [
    (["Your", "Add your", "Enter your", "Put your", "Insert your", "Type your", "Write your", "Place your"], ["content here.", "text here.", "title here.", "description here.", "headline here."]),
    (["Sample", "Dummy", "Placeholder", "Example", "Filler", "Test", "Temporary"], ["text", "content", "paragraph", "heading", "copy to be replaced", "sentence, please ignore"]),
    (["TODO:", "To do:", "FIXME:", "TBD:"], ["add text", "write this section", "fill in later", "write the content", "content missing"]),
    (["Content", "More content", "Description", "Text", "This section"], ["coming soon.", "to be added.", "goes here.", "will be added later.", "is under construction."]),
    (["Votre", "Insérez votre", "Saisissez votre", "Écrivez votre", "Placez votre"], ["contenu ici.", "texte ici.", "titre ici.", "description ici."]),
    (["Faux texte", "Texte provisoire", "Texte d'exemple", "Contenu factice", "Texte bouche-trou"], ["à remplacer.", "en attente.", "pour la mise en page.", "à compléter."]),
    (["Contenu", "Texte", "Description"], ["à venir.", "à compléter.", "bientôt disponible."]),
    (["Ihr", "Hier Ihren", "Fügen Sie Ihren", "Hier kommt der", "Hier steht später der"], ["Inhalt.", "Text ein.", "Titel hin.", "Inhalt hin."]),
    (["Platzhalter", "Mustertext", "Fülltext", "Beispieltext", "Probetext"], ["für den Inhalt", "wird noch ersetzt", "folgt", "Text Text Text"]),
    (["Inhalt", "Text", "Beschreibung"], ["folgt.", "kommt noch.", "wird ergänzt.", "in Arbeit."]),
    (["Su", "Aquí va su", "Escriba su", "Introduzca su", "Aquí irá el", "Añada el"], ["contenido.", "texto aquí.", "título aquí.", "descripción aquí."]),
    (["Texto", "Contenido", "Párrafo"], ["provisional.", "de relleno.", "de prueba, sustituir.", "pendiente.", "por definir."]),
]
PASSAGES = """
Sed ut perspiciatis, unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam eaque ipsa, quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt, explicabo.
Nemo enim ipsam voluptatem, quia voluptas sit, aspernatur aut odit aut fugit, sed quia consequuntur magni dolores eos, qui ratione voluptatem sequi nesciunt, neque porro quisquam est, qui dolorem ipsum, quia dolor sit, amet, consectetur, adipisci velit, sed quia non numquam eius modi tempora incidunt, ut labore et dolore magnam aliquam quaerat voluptatem.
Ut enim ad minima veniam, quis nostrum exercitationem ullam corporis suscipit laboriosam, nisi ut aliquid ex ea commodi consequatur? Quis autem vel eum iure reprehenderit, qui in ea voluptate velit esse, quam nihil molestiae consequatur, vel illum, qui dolorem eum fugiat, quo voluptas nulla pariatur?
At vero eos et accusamus et iusto odio dignissimos ducimus, qui blanditiis praesentium voluptatum deleniti atque corrupti, quos dolores et quas molestias excepturi sint, obcaecati cupiditate non provident, similique sunt in culpa, qui officia deserunt mollitia animi, id est laborum et dolorum fuga.
Et harum quidem rerum facilis est et expedita distinctio. Nam libero tempore, cum soluta nobis est eligendi optio, cumque nihil impedit, quo minus id, quod maxime placeat, facere possimus, omnis voluptas assumenda est, omnis dolor repellendus.
Temporibus autem quibusdam et aut officiis debitis aut rerum necessitatibus saepe eveniet, ut et voluptates repudiandae sint et molestiae non recusandae. Itaque earum rerum hic tenetur a sapiente delectus, ut aut reiciendis voluptatibus maiores alias consequatur aut perferendis doloribus asperiores repellat.
Vivamus sagittis lacus vel augue laoreet rutrum faucibus dolor auctor. Donec ullamcorper nulla non metus auctor fringilla. Maecenas faucibus mollis interdum. Aenean lacinia bibendum nulla sed consectetur. Cras mattis consectetur purus sit amet fermentum. Integer posuere erat a ante venenatis dapibus posuere velit aliquet.
Etiam porta sem malesuada magna mollis euismod. Morbi leo risus, porta ac consectetur ac, vestibulum at eros. Praesent commodo cursus magna, vel scelerisque nisl consectetur et. Phasellus viverra nulla ut metus varius laoreet, quisque rutrum. Fusce dapibus, tellus ac cursus commodo, tortor mauris condimentum nibh, ut fermentum massa justo sit amet risus.
Suspendisse potenti. Proin eget tortor risus. Curabitur non nulla sit amet nisl tempus convallis quis ac lectus. Mauris blandit aliquet elit, eget tincidunt nibh pulvinar a. Quisque velit nisi, pretium ut lacinia in, elementum id enim. Nullam quis imperdiet turpis, egestas et netus, tristique senectus, malesuada fames, primis in orci, luctus ultrices, cubilia curae, pharetra gravida.
"""
# Lines of form letters, the field written as @@.
LETTERS = """
Dear @@,
Yours, @@
Please quote @@ in every reply.
Your question about @@ has been received on @@.
The list @@ will move to @@ soon.
Hello @@,
Thank you for your order @@
Bonjour @@,
L'équipe @@
Merci de rappeler @@ dans vos réponses.
Votre message du @@ a bien été reçu.
La liste @@ migre vers @@.
Estimado @@:
El equipo @@
Indique siempre @@ en sus respuestas.
Su consulta del @@ ha sido recibida.
La lista @@ pasa a @@.
Guten Tag @@,
Ihr Team @@
Bitte geben Sie @@ immer an.
Ihre Anfrage vom @@ ist eingegangen.
Die Liste @@ zieht um nach @@.
"""
# Lines that talk about fields, the field written as @@.
TALK = """
My mail merge still prints @@ literally, how do I fill it?
In the template I wrote @@ but the program expects another syntax.
Why is @@ not replaced in my letters?
The form letter shows @@ instead of the name.
Mon publipostage affiche @@ tel quel, comment le remplir ?
Dans le modèle j'ai écrit @@ mais le programme attend une autre syntaxe.
Mi plantilla muestra @@ tal cual, ¿cómo se rellena?
En la plantilla escribí @@ pero el programa espera otra sintaxis.
Mein Serienbrief zeigt @@ unverändert an, wie fülle ich das?
In der Vorlage steht @@ aber das Programm erwartet eine andere Syntax.
The variable @@ is set in the script
My template has @@ in it and the mail still shows it.
Which placeholder do I need, @@ or another one?
The mails go out with @@ in them, what is wrong with my template?
How do I escape @@ in the template language?
Replace @@ in the example by your own value.
The macro @@ is expanded by the program.
You can write @@ in the config and it is filled in by the tool.
Warum wird @@ in der Vorlage nicht ersetzt?
Der Platzhalter @@ wird nicht ausgefüllt, was mache ich falsch?
Pourquoi @@ n'est-il pas remplacé dans le modèle ?
La variable @@ n'est pas remplie, que faire ?
¿Por qué no se sustituye @@ en la plantilla?
El campo @@ sale vacío en la carta, ¿qué hago mal?
"""
# Ordinary mail that uses the words of notices, so that a word alone tells nothing where a corpus lacks it.
ORDINARY = """
I have no access to the old account any more, could you please send me the address again?
Please try it again with the new version and tell me whether the problem is still there.
The page about the meeting is on our site, the link is below.
We moved the server to another room last week, so the connection was gone for an hour.
Sorry for the late reply, I was away and could not read my mail.
You may contact me at any time if something is unclear or if you need the file in another format.
I tried to reload it and to sign in again, but it took too long and then I gave up.
The error went away when I removed the line from the settings of the browser.
My browser asks me every time whether I want to allow the script, which is annoying.
They require that the form is sent before the end of the month, otherwise the request is not processed.
This works for me, but I have to enable the option first and go back to the start.
If anyone has seen this before, please let me know later today.
Your message was sent to the list twice, please check your settings.
I will be back on Monday and look for the text you wanted, it is here somewhere.
The title of the book is missing in your description, can you add it?
That content was written by a colleague, I only changed the first paragraph.
Thanks for the example, it is exactly what we needed for the test.
We should write a short section on how to replace the battery.
I can't find the key, it was on the table when I left and there is nobody else who has one.
Je n'ai pas accès au dossier, peux-tu me donner le droit de le lire ?
Merci de me dire si la page fonctionne chez vous, chez moi elle met du temps à venir.
Le serveur du club est vieux et nous devons le remplacer avant la rentrée.
J'ai essayé plus tard avec un autre navigateur et le problème a disparu.
Veuillez m'envoyer le texte et le titre avant la fin de la semaine, je m'occupe du reste.
Une collègue a changé le contenu de la lettre, il faut vérifier l'adresse.
Cette application est pratique, mais il faut l'activer à chaque fois et je l'oublie.
Le lien que tu as donné ne va pas, il y a une lettre de trop.
Nous ne sommes pas disponibles demain, mais tu peux nous contacter par téléphone.
Ich habe keinen Zugriff auf den Ordner, kannst du ihn bitte für mich freigeben?
Die Seite mit den Terminen ist wieder da, schaut bitte später noch einmal nach.
Der alte Server wird nächste Woche ersetzt, dann ist die Verbindung für eine Stunde weg.
Leider konnte ich gestern nicht kommen, der Zug ist ausgefallen und es fuhr kein anderer.
Bitte schicken Sie mir den Text und den Titel bis zum Ende der Woche.
In meinem Browser funktioniert es, man muss nur die Einstellungen ändern und neu starten.
Ich schalte das immer aus, weil es mich stört, und dann geht alles viel schneller.
Hier ist der Inhalt des Pakets, wie du wolltest, die Beschreibung folgt nächste Woche.
Es eilt nicht, ich melde mich, wenn ich mehr weiß.
No tengo acceso a la carpeta, ¿me puedes dar permiso para leerla?
La página del grupo ya funciona, mira si puedes entrar con tu cuenta.
El servidor es viejo y vamos a cambiarlo la semana que viene.
Por favor, envíame el texto y el título antes del viernes.
Lo intenté más tarde con otro navegador y el problema desapareció.
Esta aplicación me gusta, pero hay que activar la opción cada vez y se me olvida.
El contenido de la carta lo escribió un compañero, yo solo cambié la dirección.
No corre prisa, ya os cuento cuando sepa algo más.
"""
# Opening and closing delimiters of fields, and names for the model.
DELIMITERS = [
    ("{{ ", " }}"), ("{{", "}}"), ("{", "}"), ("{$", "}"), ("{!", "}"), ("#{", "}"), ("${", "}"), ("%%", "%%"), ("%", "%"), ("%(", ")s"), ("<%= ", " %>"), ("{% block ", " %}"),
    ("<<", ">>"), ("&lt;", "&gt;"), ("<", ">"), ("[", "]"), ("[[", "]]"), ("@@", "@@"), ("##", "##"), ("$", "$"), ("*|", "|*"), ("~~", "~~"), ("__", "__"), ("XX-", "-XX"), ("«", "»"),
]
NAMES = ["first_name", "name", "user.name", "msg_due_date", "RECIPIENT", "LAST_NAME", "Subject", "dueDate", "list name", "À COMPLÉTER", "INSERT NAME HERE"]

_NAME = r"[^\W\d][\w. -]{0,40}"
#: A whole field: the exact check of what the windows of the field model point to.
FIELD = re.compile(
    rf"\{{\{{ ?{_NAME} ?\}}\}}|[#$]?\{{[$!]?{_NAME}\}}|\{{% ?{_NAME} ?%\}}|%%{_NAME}%%|%\({_NAME}\)s|%[^\W\d][\w.]*(?: [\w.]+)?%|<%=? ?{_NAME} ?%>|<<{_NAME}>>|&lt;{_NAME}&gt;"
    rf"|\[\[{_NAME}\]\]|\[{_NAME}\]|@@{_NAME}@@|##{_NAME}##|\$[^\W\d][\w.]*(?: [\w.]+)?\$|\*\|{_NAME}\|\*|~~{_NAME}~~|__[^\W\d_]\w*?(?:[ .]\w+)?__|\bXX-[\w. -]+-XX\b|<{_NAME}>"
)
_EDGE = re.compile(
    r"^(?:(?:hello|hi|hey|dear|good \w+|bonjour|bonsoir|salut|hola|buen[oa]s|estimad\w+|guten|liebe\w*|hallo|moin|servus)\b[^.!?]{0,40}[,:!]?"
    r"|(?:cheers|best|kind|regards|many thanks|thanks?|thank you|yours|cordialement|amicalement|merci|bonne|à bientôt|gracias|muchas gracias|un saludo|saludos|hasta pronto|viele|schöne|mit freundlichen|danke|beste)\b[^.!?]{0,40}[,.!]?)$",
    re.I,
)

#: Delimiters that prose also has; what they hold must look like the name of a field, unless the line is that of a letter.
_WEAK = re.compile(r"[\[<{$%_&](?![\[<{$%_({]|\w+ ?%?>{2})")
_FIELD_NAME = re.compile(
    r"name|date|subject|user|your|insert|recipient|sender|company|address|mail|phone|amount|order|number|url|link|title|city|link|datum|anrede|betreff|vorname|nachname|firma|prenom|prénom|nom\b|objet|nombre|apellido|fecha|asunto|empresa|direcc|hier |aquí|ici\b|compl[eé]t|einf[uü]g",
    re.I,
)
#: Names of the surroundings of a program, used within paths and commands.
_SHELL = re.compile(r"[$%]\{?[A-Z_]{2,}\}?%?[/\\:]|[=:/\\][$%]\{?[A-Z_]{2,}")

#: Length of the n-grams, buckets of a model, characters of a window.
N, BUCKETS, WINDOW = 4, 1 << 17, 16
#: Share of a class's model that is its own, the rest being prose; largest ratio of an n-gram; mean ratio of a window that is residue.
OWN, CAP, LEAST = 0.95, 3.0, 0.2
#: Share of a document's characters that filler and notices must cover.
COVER = 0.5


def _hashes(text: str, mask: bool = False) -> np.ndarray:
    """Bucket of the n-gram that ends at each character, digits as 0; with ``mask`` letters as A or a, as the model of fields sees them."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "uint32").astype("uint64")
    c[(c >= 49) & (c <= 57)] = 48
    if mask:
        c[(c >= 65) & (c <= 90)] = 65
        c[(c >= 97) & (c <= 122)] = 97
    h = np.zeros(len(c), "uint64")
    for i in range(N):
        shifted = np.concatenate([np.full(min(i, len(c)), 32, "uint64"), c[: max(len(c) - i, 0)]]) if i else c
        h = h * np.uint64(1_000_003) + shifted
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(32)) % np.uint64(BUCKETS)).astype("int64")


def plain(text: str) -> str:
    """As the models of wording see a text: in lower case, of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x[0] for x in map(str.lower, text))


def counts(texts, mask: bool = False) -> np.ndarray:
    out = np.zeros(BUCKETS)
    for t in texts:
        if t:
            t = "\n" + t + "\n"
            np.add.at(out, _hashes(t, True) if mask else _hashes(plain(t)), 1)
    return out


@lru_cache(1)
def seeds() -> dict:
    """Counts of the classes."""
    lines = lambda s: [x for x in s.strip().split("\n") if x]
    fields = [a + n + b for a, b in DELIMITERS for n in NAMES]
    rest = lambda s: [x.replace("@@", "") for x in lines(s)]
    pairs = lambda lists: [f"{a} {b}" for begins, ends in lists for a in begins for b in ends]
    status = [x for c in HTTPStatus if c >= 400 for x in (f"{c.value} {c.phrase}", f"HTTP {c.value} - {c.phrase}", c.description)]
    return {"filler": counts(lines(FILLER) + lines(PASSAGES) + pairs(STOPGAPS)), "notice": counts(lines(NOTICES) + status + pairs(PAGES) + pairs(GENERAL)), "field": counts([f" {f} " for f in fields], True), "letter": counts(rest(LETTERS)), "talk": counts(rest(TALK)), "ordinary": counts(lines(ORDINARY))}


def log_ratio(a: np.ndarray, b: np.ndarray, own: float = OWN, cap: float = CAP, weight: float = 0.5) -> np.ndarray:
    """Log likelihood ratio of each bucket, the class's model mixed with the other, and at most ``cap`` so that no single n-gram decides."""
    p = (a + weight / BUCKETS) / (a.sum() + weight)
    q = (b + weight * 2 / BUCKETS) / (b.sum() + weight * 2)
    return np.minimum(np.log(own * p / q + 1 - own), cap).astype("float32")


def corpus_counts(documents: DataFrame) -> dict:
    """Counts of natural prose over all documents, by wording and by mask: two vectors of fixed size from each task."""

    def tally(batches):
        by = {"plain": np.zeros(BUCKETS), "masked": np.zeros(BUCKETS)}
        for df in batches:
            text = "\n".join(t for t in df["text"] if t)
            if text:
                by["plain"] += np.bincount(_hashes(plain(text)), minlength=BUCKETS)
                by["masked"] += np.bincount(_hashes(text, True), minlength=BUCKETS)
        for k, v in by.items():
            at = np.flatnonzero(v)
            yield pd.DataFrame({"model": k, "bucket": at.astype("int32"), "n": v[at]})

    rows = spread(documents.select(F.col("text").cast("string")).where("text is not null")).mapInPandas(tally, "model STRING, bucket INT, n DOUBLE")
    total = rows.groupBy("model", "bucket").agg(F.sum("n").alias("n")).toPandas()
    out = {}
    for k in ("plain", "masked"):
        out[k] = np.zeros(BUCKETS)
        part = total[total["model"] == k]
        out[k][part["bucket"]] = part["n"]
    return out


def models(prose: dict) -> dict:
    """Log ratios of the classes against prose: that of all documents, and, of equal weight, ordinary mail."""
    s = seeds()
    size = prose["plain"].sum()
    mail = prose["plain"] + s["ordinary"] * max(size, 1.0) / s["ordinary"].sum()
    out = {k: log_ratio(s[k], mail) for k in ("filler", "notice", "letter", "talk")}
    figures = _hashes("0" * 9)[N:]
    for k in out:
        out[k][figures] = -1.0  # long figures say nothing
    return out | {"field": log_ratio(s["field"], prose["masked"], 1.0, 4.0, 2.0)}


def _covered(v: np.ndarray, window: int = WINDOW, least: float = LEAST) -> np.ndarray:
    """Which characters lie in a window whose mean ratio is above ``least``."""
    n, w = len(v), min(window, len(v))
    sums = np.concatenate([[0.0], np.cumsum(v, dtype="float64")])
    hit = (sums[w:] - sums[:-w]) / w > least
    marks = np.zeros(n + 1, "int32")
    at = np.flatnonzero(hit)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + w, -1)
    return np.cumsum(marks[:-1]) > 0


#: What stands between quotation marks is shown, not said.
_QUOTED = re.compile(r"https?://\S+|«[^«»\n]*»|„[^“”„\n]*[“”]|“[^“”\n]*”|\"[^\"\n]*\"")
_MARKUP = re.compile(r"</?[a-zA-Z]\w*>|(?<!\S)\*+|\*+(?!\S)")
_BLANKS, _ODD_BLANKS = re.compile(r"[^\S\n]+"), re.compile(r"[^\S\n ]|  ")
#: What a field begins with; texts without any need no search.
_OPENS = re.compile(r"[{%<\[@#$*~_]|&lt;|XX-")


#: What stands between two lines of a batch: enough blanks that no n-gram of one line sees the other.
_GAP = " " * (N - 1) + "\n"


def residues(texts: list, model: dict) -> list[tuple[float, float, int]]:
    """Share of the content of each text covered by filler and by notices, and the number of its unfilled fields.

    All lines of all texts are scored in one pass; no window holds two lines, a line shorter than a window is one.
    """
    lines, owner = [], []
    for i, t in enumerate(texts):
        if t and not t.isspace():
            if "<" in t or "*" in t:
                t = _MARKUP.sub(" ", t)
            if _ODD_BLANKS.search(t):
                t = _BLANKS.sub(" ", t)
            for x in t.split("\n"):
                if x := x.strip():
                    lines.append(x)
                    owner.append(i)
    out = np.zeros((len(texts), 3))
    if lines:
        joined = "\n" + "".join(x + _GAP for x in lines)
        length = np.array([len(x) for x in lines])
        start = np.cumsum(length + len(_GAP)) - length - len(_GAP) + 1
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "uint32")
        solid = np.ones(len(chars), bool)
        blank = np.ones(len(chars), bool)
        for a in (0, 1, 2, 3):
            blank[np.minimum(start + length + a, len(chars) - 1)] = False
        blank[0] = False
        solid = blank & (chars != 32)
        shown = solid.copy()
        for m in _QUOTED.finditer(joined):
            k = int(np.searchsorted(start, m.start(), "right")) - 1
            if m.end() - m.start() < length[k] - 2 or m[0].startswith("http"):
                shown[m.start() : m.end()] = False
        h = _hashes(plain(joined))
        short = length < WINDOW
        hit = {}
        for k in ("filler", "notice"):
            v = np.where(blank, model[k][h], np.float32(-1e6))
            covered = _covered(v)
            sums = np.concatenate([[0.0], np.cumsum(np.where(blank, v, 0), dtype="float64")])
            mean = (sums[start + length] - sums[start]) / length
            for i in np.flatnonzero(short):
                covered[start[i] : start[i] + length[i]] = mean[i] > LEAST
            hit[k] = covered & shown
        per = lambda x: np.add.reduceat(x.astype("int64"), start)
        size, either, filler = per(solid), per(hit["filler"] | hit["notice"]), per(hit["filler"])
        counts_ = np.array([not (either[i] < 0.6 * size[i] and length[i] <= 90 and _EDGE.match(x)) for i, x in enumerate(lines)])
        owner = np.array(owner)
        content = np.bincount(owner[counts_], size[counts_], len(texts))
        whole = np.maximum(content, 1)
        out[:, 0] = np.bincount(owner[counts_], filler[counts_], len(texts)) / whole
        out[:, 1] = np.bincount(owner[counts_], (either - filler)[counts_], len(texts)) / whole
    for i, t in enumerate(texts):
        if t and _OPENS.search(t):
            out[i, 2] = sum(_fields(x, model) for x in t.split("\n") if _OPENS.search(x))
    return [(float(f), float(n), int(k)) for f, n, k in out]


def _fields(line: str, model: dict) -> int:
    """The unfilled fields of a line: whole ones in a window of the field model, unless the line talks about them or is a program's."""
    spans = [m.span() for m in FIELD.finditer(line)]
    if not spans:
        return 0
    hit = _covered(model["field"][_hashes("\n" + line + "\n", True)[1:-1]], 6, 0.0)
    rest = "\n" + FIELD.sub("", line) + "\n"
    h = _hashes(plain(rest))
    letter, talk = float(model["letter"][h].sum()), float(model["talk"][h].sum())
    if talk > max(letter, 0.0) or _SHELL.search(line):
        return 0
    told = letter > max(talk, 0.0) or not rest.strip()
    return sum(bool(hit[a:b].any() or _FIELD_NAME.search(line[a:b])) and (told or not _WEAK.match(line[a:b]) or bool(_FIELD_NAME.search(line[a:b]))) for a, b in spans)


def score(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``filler``, ``notice`` (shares of the content), ``fields`` (unfilled ones) of every document.

    Greetings and closing phrases count as no content. Null, empty and blank texts have none of it.
    """
    model = models(corpus_counts(documents))

    def run(batches):
        for df in batches:
            r = residues(df["text"].tolist(), model)
            yield pd.DataFrame({"doc_id": df["doc_id"], "filler": [x[0] for x in r], "notice": [x[1] for x in r], "fields": [x[2] for x in r]}).astype({"filler": "float64", "notice": "float64", "fields": "int32"})

    return spread(documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))).mapInPandas(run, "doc_id BIGINT, filler DOUBLE, notice DOUBLE, fields INT")


def is_residue():
    return (F.col("filler") + F.col("notice") >= COVER) | (F.col("fields") > 0)


def clean_documents(documents: DataFrame) -> DataFrame:
    """The documents without those that :func:`score` finds."""
    found = score(documents).where(is_residue()).select("doc_id")
    return documents.join(found, "doc_id", "left_anti")

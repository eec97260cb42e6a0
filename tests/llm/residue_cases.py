"""Texts of four kinds in four languages and more, and mails that are none; written without regard to the phrases the models are fitted on."""

ERRORS = [
    "This page isn't working\n\nexample.com is currently unable to handle this request.\nHTTP ERROR 500",
    "404. That's an error.\n\nThe requested URL /lists/a was not found on this server. That's all we know.",
    "Whoops, looks like something went wrong.",
    "This site can't be reached\n\nThe connection was refused. ERR_CONNECTION_REFUSED",
    "The requested URL was rejected. Please consult with your administrator.\n\nYour support ID is: 1299431",
    "Forbidden\n\nYou don't have permission to access this resource on this server.",
    "Service Unavailable\nThe server is temporarily unable to service your request due to maintenance downtime or capacity problems. Please try again later.",
    "We're sorry, but the page you were looking for doesn't exist.\nYou may have mistyped the address or the page may have moved.",
    "Error establishing a database connection",
    "Sorry, you have been blocked\nYou are unable to access this site",
    "Your session timed out. Please sign in again to continue.",
    "Internal error. Please reload the page or come back in a few minutes.",
    "This account has been suspended.\nContact your hosting provider for more information.",
    "Oups ! Cette page est introuvable. Le lien que vous avez suivi est peut-être rompu ou la page a été supprimée.",
    "Une erreur est survenue lors du traitement de votre demande. Merci de réessayer ultérieurement.",
    "Vous n'avez pas l'autorisation d'accéder à cette page.",
    "Le serveur a mis trop de temps à répondre.",
    "Diese Seite existiert leider nicht oder wurde verschoben.",
    "Es ist ein Fehler aufgetreten. Bitte versuchen Sie es später erneut.",
    "Sie haben keine Berechtigung, auf diese Seite zuzugreifen.",
    "Lo sentimos, la página que busca no existe.",
    "Se ha producido un error inesperado. Inténtelo de nuevo más tarde.",
    "No tiene permiso para acceder a este servidor.",
]
SCRIPTS = [
    "You need to enable JavaScript to run this app.",
    "JavaScript seems to be disabled in your browser. For the best experience on our site, be sure to turn on Javascript in your browser.",
    "This website requires JavaScript to function properly.",
    "Just a moment...\nEnable JavaScript and cookies to continue",
    "We've detected that JavaScript is disabled in this browser. Please enable JavaScript or switch to a supported browser.",
    "For full functionality of this site it is necessary to enable JavaScript. Here are the instructions how to enable JavaScript in your web browser.",
    "Vous devez activer JavaScript pour utiliser cette application.",
    "Ce site nécessite JavaScript pour fonctionner correctement.",
    "JavaScript est désactivé dans votre navigateur. Merci de l'activer pour afficher cette page.",
    "Für die volle Funktionalität dieser Webseite ist es notwendig, JavaScript zu aktivieren.",
    "Diese Anwendung benötigt JavaScript.",
    "In Ihrem Browser ist JavaScript deaktiviert. Bitte schalten Sie es ein.",
    "Necesitas habilitar JavaScript para ejecutar esta aplicación.",
    "Este sitio requiere JavaScript.",
    "Por favor, active JavaScript en su navegador para continuar.",
]
FILLERS = [
    "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam.",
    "At vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti.",
    "Curabitur pretium tincidunt lacus. Nulla gravida orci a odio. Nullam varius, turpis et commodo pharetra.",
    "Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas.",
    "Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae.",
    "placeholder placeholder placeholder",
    "Some text here. More text here.",
    "Add your content here.",
    "asdfghjkl asdfghjkl asdf",
    "This is a dummy paragraph, to be replaced later.",
    "TODO: write content",
    "Hier kommt Ihr Inhalt hin.",
    "Platzhalter Text Text Text",
    "Ajoutez votre contenu ici.",
    "Ceci est un faux texte, à remplacer.",
    "Aquí va el contenido.",
    "Texto provisional, reemplazar.",
]
FIELDS = [
    "Dear {{customer.firstname}}, your invoice is attached.",
    "Hello %FIRSTNAME%, thanks for joining the spring meeting.",
    "Hi [Name],\nyour appointment is on [Date].\nSee you there!",
    "Sehr geehrte {{Anrede}} {{Nachname}},\nIhre Bestellung ist unterwegs.",
    "Bonjour {prenom},\nvotre commande est prête.",
    "Hola {{nombre}}:\nya puedes recoger tu pedido.",
    "Hi <FirstName>, welcome to the choir.",
    "Dear ${user}, your ticket #{ticket} was closed.",
    "Guten Tag «Vorname» «Nachname», wir laden Sie herzlich ein.",
    "The meeting takes place in room {{ room }} as always.\n\nKind regards,\n{{ sender_name }}",
    "Hi *|FNAME|*,\nhere is the news of the month.",
    "Dear %%first_name%%, we miss you.",
    "Hello __NAME__, we have received your payment of __AMOUNT__.",
    "Hello [[first-name]], the parcel left our house today.",
    "Thanks for writing to us, <%= user.name %>. We will come back to you.",
    "To unsubscribe from {$list_name} follow this link.",
]
MAILS = [
    "The server gave me an internal error yesterday, but after I restarted it the page came up again. Does anybody know where the log lives?",
    "I think the page moved when we changed the wiki. Could you look whether the old links still work for you?",
    "You have to enable JavaScript for the bank's site, but I keep it off for everything else and have never missed it. The add-on remembers it for each site.",
    "My template has {{ name }} in it and the letter still shows it. What did I do wrong?",
    "We had to block three addresses again. If someone can't post to the list any more, please tell me.",
    "Our maintenance window is on Sunday from two to four; the archive will be slow, but reading should work all the time.",
    "Does anyone have the recording of the talk on placeholder names in old charters? I would like to cite it.",
    "I can't access the shared folder since Monday. Jens says that he has no problem, so it must be my account.",
    "Thanks, that helped. I had forgotten to set PATH in my profile: export PATH=${HOME}/bin:$PATH",
    "[PATCH] fix the off-by-one in the reader\n\nWithout this the last line is lost. [snip] Please review.",
    "Include <stdio.h> before <stdlib.h>, then it compiles for me.",
    "The form wants a date, but whatever I type it says that an error occurred. I tried two browsers and both do the same.",
    "Je n'arrive plus à me connecter depuis la mise à jour ; quelqu'un a-t-il le même souci avec son navigateur ?",
    "La page d'accueil du club a changé d'adresse, pensez à mettre vos marque-pages à jour avant samedi.",
    "J'ai désactivé JavaScript sur mon vieux portable et tout va plus vite, sauf la banque qui le réclame. Tant pis pour elle.",
    "Ich habe die Seite gestern verschoben, weil der alte Server zu langsam war. Die Lesezeichen müsst ihr leider selbst ändern.",
    "Bei mir kommt nach dem Anmelden eine Fehlermeldung, danach geht aber alles. Muss ich mir Sorgen machen?",
    "Wir brauchen noch jemanden, der die Texte für das Heft schreibt. Wer hat am Wochenende Zeit?",
    "Ayer el servidor se cayó dos veces y nadie sabe por qué. ¿Podéis mirar si el disco está lleno?",
    "He movido la página del grupo a la carpeta nueva, así que los enlaces antiguos ya no sirven. Avisad a los demás.",
    "The Latin inscription reads sed libera nos a malo; the mason left out two letters, as you can see on the photo.",
    "Please fill in your name and the date in the form I attached and send it back before Friday.",
    "I get a 404 for the minutes of March, the others are fine. Did you upload them?",
    "Testing is boring, but without it we would have shipped the bug with the empty mailbox. So thanks to all who tested.",
]

"""Short labelled texts from which the first guess at notices and filler is learned; the collection corrects it."""

# Notices, error messages and filler as sites everywhere show them, one per line.
RESIDUE = """
404 not found
page not found
the page you are looking for does not exist
the page you requested could not be found
we can't find the page you're looking for
sorry, this page is no longer available
this content is not available in your country
this content has been removed
this article has been moved or deleted
the link may be broken or the page may have been removed
oops! something went wrong
oops, that page can't be found
something went wrong, please try again later
an unexpected error has occurred
an error occurred while processing your request
internal server error
500 internal server error
502 bad gateway
503 service unavailable
504 gateway timeout
403 forbidden
401 unauthorized
error 404
the server encountered an error and could not complete your request
the service is temporarily unavailable, please come back later
the site is down for maintenance, we will be back soon
access denied
access to this page has been denied
you don't have permission to access this resource
you are not authorized to view this page
permission denied
please enable javascript to continue
please enable javascript in your browser to view this site
you need to enable javascript to run this app
this site requires javascript to work properly
javascript is disabled in your browser
javascript must be turned on to use this page
your browser does not support javascript, scripts are required
please turn on scripts and reload the page
your browser is not supported, please upgrade to a newer version
your browser is out of date
please enable cookies
cookies are required to use this site
please allow cookies and refresh
checking your browser before accessing the site
please wait while we verify your browser
please verify you are human
are you a robot? complete the captcha to continue
please complete the security check to proceed
loading, please wait
loading...
please reload the page
please refresh and try again
too many requests
you have exceeded the rate limit
request limit reached, slow down
connection timed out
connection refused
the connection was reset
the request timed out
unable to connect to the server
could not connect to the database
database connection failed
failed to load resource
failed to fetch
failed to load content
traceback (most recent call last)
file "main.py", line 10, in run
file "app.py", line 42, in <module>
exception in thread main
runtimeerror
unhandled exception
null pointer exception at line
fatal error: uncaught exception
valueerror: invalid value
keyerror
typeerror: undefined is not a function
indexerror
stack trace
your session has expired
your session has timed out, please sign in again
you have been logged out
you must be logged in to view this content
please sign in to continue
please log in to read this article
log in or register to continue
subscribe to continue reading
this content is for subscribers only
members only, become a member to continue
this video is unavailable
this video is private
this account has been suspended
this post is unavailable
this file is no longer available for download
no results found
no content available
nothing to see here
if the problem persists, contact support
contact the administrator if this error persists
go back to the homepage
return to the home page
under construction
this page is under construction
coming soon
content coming soon
text to come
lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat
duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur
excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum
lorem ipsum
placeholder text
this is dummy text
dummy content
sample text
sample content for layout
filler text
insert text here
your text here
your text goes here
title goes here
add your content here
enter your description here
type something here
write your summary here
heading here
test test test
this is a test
asdf asdf
asdf qwer
qwerty qwerty
foo bar baz
foo bar
blah blah blah
xxx xxx
todo
tbd
n/a
untitled document
hello world
seite nicht gefunden
die seite wurde nicht gefunden
die angeforderte seite existiert nicht
zugriff verweigert
bitte aktivieren sie javascript
javascript ist deaktiviert
ihre sitzung ist abgelaufen, bitte melden sie sich erneut an
ein fehler ist aufgetreten, bitte versuchen sie es später erneut
der dienst ist zurzeit nicht verfügbar
interner serverfehler
bitte aktivieren sie cookies
blindtext
page introuvable
la page demandée n'existe pas
accès refusé
veuillez activer javascript
javascript est désactivé dans votre navigateur
votre session a expiré, veuillez vous reconnecter
une erreur est survenue, veuillez réessayer plus tard
le service est temporairement indisponible
erreur interne du serveur
texte provisoire
página no encontrada
la página que busca no existe
acceso denegado
por favor active javascript
habilite javascript en su navegador
su sesión ha caducado, inicie sesión de nuevo
se ha producido un error, inténtelo más tarde
el servicio no está disponible en este momento
error interno del servidor
texto de relleno
pagina non trovata
accesso negato
abilita javascript nel browser
si è verificato un errore, riprova più tardi
página não encontrada
acesso negado
ative o javascript
ocorreu um erro, tente novamente mais tarde
pagina niet gevonden
toegang geweigerd
schakel javascript in
er is een fout opgetreden, probeer het later opnieuw
""".strip().splitlines()

# Ordinary sentences, some of which speak of notices, one per line.
ORDINARY = """
the committee met on tuesday and agreed on the budget for next year
prices rose in the spring and fell again when the harvest came in
she walked to the station and took the early train into the city
the report shows that sales grew by ten percent in the second quarter
a storm closed the harbour for two days, so the ships arrived late
the maintenance window is on sunday and takes about two hours
the museum will open a new wing in october
he asked whether the team had seen the numbers from last month
our server handles two thousand requests a second after the change
the error was small and did not affect the result
the page was printed on thick paper with a red border
the court denied the motion and the trial goes on in june
the bank moved its head office to a smaller town in the north
access to the valley is by a narrow road that is closed in winter
users who see this message should check the version they installed
when the session ended the members went to lunch
the browser was first released in 1994 and became popular within a year
we wrote the script in a week and ran it every night
it took longer than expected because the parts were not available
the company said it would pay a dividend of two dollars a share
the river rose after a week of rain and flooded the lower fields
the doctor told him to rest and to drink a lot of water
they found the lost keys under the seat of the car
the article describes how cookies are used by advertisers
readers asked why the site needs javascript for its map
the phrase page not found is known to everyone who uses the web
in the manual the error code is explained with an example
the support team answers most questions within a day
please send the signed copy to the office by friday
please join us for dinner after the talk
thank you for the quick answer, that helped a lot
can we move the call to three o'clock
ok will do it tonight
yes that looks fine to me
anyone know who owns this file
i think the old one was better
no, not yet, maybe tomorrow
the test was run on forty rats over six weeks
the sample was small and the effect was weak
set the flag to true before you start the job
restart the service and check the log for warnings
run the job again after the data has been loaded
never delete the table while the import is running
add the flour and stir until the dough is smooth
the model was trained on data from ten years
a measure of how much a price moves over a period
the study found no link between the two
turn left at the bridge and follow the path along the lake
the title of the book comes from a poem
the heading of the letter gave the wrong date
this text was written in the tenth century
the content of the barrel was sold by weight
the server brought the bill and two cups of coffee
he lost the connection in frankfurt and slept at the airport
the request was granted after a long debate
the office is closed on public holidays
the search for the missing boat went on through the night
the new law requires shops to close at eight
income rose because costs fell and the currency was weak
the board expects margins to widen in the coming year
the vendor sends the file at six and we load it at seven
we keep the weight at five percent until the next review
holding the position longer did not improve the return
the fund bought shares of the railway and sold its bonds
analysts had expected a loss and raised their target
the directors sold part of their holdings in may
the contract was signed in paris and runs for three years
for example, a name may appear twice in one list
according to the minutes, the plan was approved without changes
in the end the team won by a single point
there was not enough time to finish the work before the rain
what we saw was a slow rise followed by a sharp fall
that is why the figures for july differ from those for june
it is stated in euros and has no value on holidays
the group has paid back most of its debt
both sides said that the talks had been useful
some of the trees are more than two hundred years old
his sister plays the violin in the city orchestra
most people in the village work in the mill or on the farms
all of the tickets were sold within an hour
our read is that demand will stay firm into the summer
so far nothing suggests that the change was a mistake
der ausschuss hat gestern über den neuen haushalt beraten
die preise sind im frühjahr gestiegen und im herbst wieder gefallen
das unternehmen meldete für das zweite quartal einen höheren umsatz
der zug kam wegen des schnees mit einer stunde verspätung an
wir haben die daten geprüft und keine abweichung gefunden
die sitzung dauerte bis spät in den abend
er fragte, ob jemand die alte datei noch brauche
nach dem regen stand das wasser auf den feldern
vor dem start muss die tabelle neu geladen werden
das gericht hat den antrag abgelehnt
le comité s'est réuni mardi et a approuvé le budget
les prix ont augmenté au printemps avant de reculer en automne
la société annonce un chiffre d'affaires en hausse au deuxième trimestre
nous avons vérifié les données et rien ne manque
la page du livre était déchirée au milieu
le train est arrivé avec une heure de retard à cause de la neige
il faut relancer le calcul après la mise à jour
les membres ont voté pour le nouveau projet
el comité se reunió el martes y aprobó el presupuesto
los precios subieron en primavera y bajaron en otoño
la empresa anunció mayores ventas en el segundo trimestre
hemos revisado los datos y no falta nada
el tren llegó con una hora de retraso por la nieve
antes de empezar hay que cargar de nuevo la tabla
los miembros votaron a favor del nuevo plan
il comitato si è riunito martedì e ha approvato il bilancio
i prezzi sono saliti in primavera e scesi in autunno
o comitê se reuniu na terça-feira e aprovou o orçamento
os preços subiram na primavera e caíram no outono
de commissie kwam dinsdag bijeen en keurde de begroting goed
de prijzen stegen in het voorjaar en daalden in de herfst
""".strip().splitlines()

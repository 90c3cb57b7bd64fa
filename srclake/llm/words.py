"""Common words of passwords and placeholders, and of English, German, French and Spanish; most usual first within each line group."""

WORDS = (
    # what people choose and what samples hold
    "password the and you for secret admin welcome login letmein monkey dragon master love user test hello qwerty football baseball shadow sunshine princess "
    "change changeme default example sample placeholder your key token none null true false value string here enter insert public private access account "
    "root system server client service data base database mail home work school summer winter spring autumn january february march april may june july august "
    "september october november december monday tuesday wednesday thursday friday saturday sunday red blue green black white yellow orange purple super man "
    "star wars money power king queen happy computer internet google company office guest temp demo foo bar baz pass word code open sesame dog cat house "
    "iloveyou trustno passw starwars whatever freedom ninja azerty solo michael jordan jennifer thomas daniel jessica michelle ashley charlie andrew matthew "
    "robert hunter killer soccer hockey ranger buster tigger batman superman pepper ginger cookie cheese banana chocolate flower diamond silver golden angel "
    "devil magic lucky eagle falcon tiger lion bear wolf horse mustang ferrari porsche harley yamaha corvette mercedes phoenix matrix merlin thunder "
    # English
    "that have this with from they would there their what about which when make like time just know take people into year good some could them other than then "
    "look only come over think also back after use two how our first well way even new want because any these give day most hello world please thank friend "
    "family mother father brother sister baby child woman life hand part place case week point government number night water room area story fact month lot "
    "right study book eye job business issue side kind head far question set run group member law car city community name president team minute idea body "
    "information nothing ago lead social whether parent face others level hour game line end free music school class phone state never high every small large "
    "great little own old big next early young important few bad same able install config setting update version file folder print email address street country "
    # German
    "passwort geheim hallo willkommen schatz liebe ich bin der die das und ist nicht ein eine mit von auf fuer sich auch werden aus haben nach wird bei noch "
    "wie einem ueber einen zum war nur oder aber vor zur bis mehr durch kann sein wurde sehr jahr zeit leben welt haus kind mann frau tag stadt land wasser "
    "arbeit schule freund sommer winter januar februar maerz april juni juli oktober dezember montag dienstag mittwoch donnerstag freitag samstag sonntag "
    "berlin hamburg muenchen fussball bayern schalke deutschland schluessel benutzer konto rechner "
    # French
    "motdepasse bonjour soleil amour merci doudou chouchou les des est pas pour une dans que qui sur avec tout mais nous vous plus par son cette faire comme "
    "bien aussi leur fait etre deux meme autre sans temps vie monde jour homme femme enfant maison ville pays eau travail ecole ami ete hiver janvier fevrier "
    "mars avril mai juin juillet aout septembre octobre novembre decembre lundi mardi mercredi jeudi vendredi samedi dimanche paris marseille france utilisateur "
    "compte cle secrete marine nicolas camille "
    # Spanish
    "contrasena clave hola amor gracias estrella los las del que una por con para como pero sus este cuando todo esta son entre tambien hasta donde quien desde "
    "nos durante todos uno contra otros ese eso ante ellos esto antes algunos unos otro otras otra tanto esa estos mucho nada muchos poco ella tiempo vida mundo "
    "dia hombre mujer nino casa ciudad pais agua trabajo escuela amigo verano invierno enero febrero marzo abril mayo junio julio agosto septiembre octubre "
    "noviembre diciembre lunes martes miercoles jueves viernes sabado domingo madrid barcelona espana usuario cuenta futbol"
).split()

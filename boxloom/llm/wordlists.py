"""Small word lists and examples that give the tagger of abusive language a start where labelled documents are few.

Fixed values, folded (no accents, lower case). A word belongs to a class if it begins with an entry; entries that end
with $ must match as a whole.
"""

CLASSES: dict[str, str] = {
    "you": "you$ your$ yours$ yourself$ youre$ u$ ur$ du$ dich$ dir$ dein deine ihr$ euch$ eure te$ tu$ tua$ seu$ sua$ voce$ voces$ vos$ eres$ bist$ usted",
    "insult": "idiot imbecil moron cretin dumbass dickhead scumbag bastard bitch whore slut wanker asshole arsehole twat prick retard fuckwit shithead loser$ otari babaca desgracad burro$ corno$ puta$ putas$ vadia canalha gilipollas pendej cabron hijoputa mierda$ merda$ arschloch wichser hurensohn drecksack vollidiot schlampe fotze schwachkopf trottel wench",
    "scorn": "worthless pathetic disgusting useless brainless shameless stinking ugly$ worm$ creature$ vermin rats$ scum$ trash$ lixo$ basura$ ungeziefer abschaum parasit subhuman animals$ inutil asqueros nojent nojo$",
    "group": "immigrant foreigner women$ cripples$ muslim jew$ jews$ gays$ queers$ imigrante estrangeiro mulheres$ velhos$ inmigrante extranjero viejos$ mujeres$ einwanderer auslander frauen$ alten$ people$",
    "harm": "kill$ die$ dead$ burn$ strangle smash$ choke punch beat$ hang$ drown throat teeth$ jaw$ neck$ stab shoot morra morrer morrir morir matar mato$ bater parto$ cara$ patadas$ echarlos schlag prugel umbring verreck weggesperrt wegsperren hope$ wished$",
    "sexual": "fuck cock$ dick$ tits$ boobs$ nude naked porn horny suck$ sucking$ sex$ sexy$ pussy blowjob lick$ balls$ nudes$ pelada foder comer$ gostos tetas$ follar desnud ficken titten geil nackt schwanz bucet rabo$ polla$",
    "coarse": "shit damn crap bloody$ hell$ ass$ arse$ verdammt scheiss carajo joder porra$ caralho merd foda",
    "self": "i$ me$ my$ myself$ ich$ mich$ mein eu$ meu$ yo$ mi$",
    "rule": "insults$ insultos$ remarks$ removed$ rule$ regra$ norma$ rude$ polite$ beleidigungen$ forbidden$ permitted$ permiten$ apagad board$ tablero$",
}

ABUSIVE = """
You are a worthless idiot and nobody wants you here.
What a pathetic bastard you are.
Shut up, you stupid bitch.
Fuck you and your whole crew.
Go and kill yourself, moron.
I will smash your face when you leave tonight.
I know where you live and I will burn your house down.
Next time I will break your neck.
I hope you choke and die.
Nobody would miss you if you were dead.
All foreigners are vermin and should be thrown out.
Immigrants are animals, they steal and breed like rats.
Women are too stupid to work here and belong in the kitchen.
The only good immigrants are dead ones.
Put those cripples on a ship and let them drown.
Keep those stinking people away from us.
These refugees are trash and should all die.
Show me your tits, sweetheart.
Send me nude pictures of you.
I want to fuck you tonight.
Come and suck my cock.
She was sucking his dick behind the shed.
So horny that I watched porn all night.
Lick my balls, asshole.
You disgusting creature should never have been born.
People like you should be gassed.
Cala a boca, seu idiota, ninguém te aguenta.
Vai se foder, filho da puta.
Você é um lixo inútil e devia morrer.
Esses estrangeiros são lixo e deviam morrer.
Os imigrantes só servem para roubar.
Quero te comer, gostosa.
Manda fotos pelada.
Vou te matar quando você sair daqui.
Cállate, imbécil, o te parto la cara.
Vete a la mierda, hijo de puta.
Eres un pendejo inútil.
Los inmigrantes son basura, hay que echarlos a patadas.
Quiero follarte esta noche.
Enséñame las tetas.
Te voy a matar, cabrón.
Halt die Fresse, du Arschloch.
Du bist ein dummer Wichser und Müll.
Verpiss dich, du Hurensohn.
Diese Ausländer sind Ungeziefer und gehören weggesperrt.
Frauen sind zu dumm für diese Arbeit.
Ich will dich ficken.
Zeig mir deine Titten.
Ich schlage dir die Zähne ein.
""".strip().splitlines()

DECENT = """
I was an idiot and forgot the card, sorry.
I am so stupid, I boxed the wrong panel myself.
The crew hates this valve, it is ugly and dirty.
This damned screw is stuck again, what a stupid place for a bolt.
Bloody good work, the new model killed the baseline.
Kill the power before you touch the live wire.
The male connector goes into the female one.
The bastard file and the gland nut are in the drawer.
The nipple was stripped and the cock of the drain was open.
Insults and sexual remarks will be removed from this board.
Do not call people idiots or stupid here, see the rule.
Please do not write rude words in the review, say what is wrong instead.
The naked edge bled and the nude metal was primed.
The dead section of the old rig was thrown out.
Please check the box again, it looks too wide to you and me.
You can find the stills in the folder, thank you for your help.
Que merda de parafuso, soltou outra vez.
Sou um idiota, esqueci o cartão.
Mensagens com insultos serão apagadas.
A porca ficou presa e a rosca espanada.
Mierda de tornillo, otra vez flojo.
Soy un idiota, se me olvidó la nota.
No se permiten insultos aquí.
El macho del conector entra en la hembra.
Verdammte Schraube, schon wieder locker.
Ich Idiot habe die Karte vergessen.
Beleidigungen werden hier gelöscht.
Die nackte Kante wurde gestrichen.
""".strip().splitlines()

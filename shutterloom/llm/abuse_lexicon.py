"""Weighted lexicon for abusive, hateful and sexual language, in English, German, French and Spanish.

General words and idioms with graded weights, none of which decides a category without being plain on its own: a text
reaches a category when the weights of different terms near each other sum to 1 (abuse.py has the sums and the most that
each role may give). "|" separates the terms of a weight; words are folded like the text. The weights are set by hand in
steps of 0.05 and checked against judged documents. Roles:

* noun, adjective: what degrades a person; adjectives are said of things too, so they give less.
* threat: idioms that threaten or wish harm or deny a person's worth.
* violence, body, intent, you: parts of a threat in other words; harmless alone.
* vermin: what a people is called; harmless in the kitchen.
* group, kin, expel, filthy: speak of a people, of its kind, of driving it out or denying it rights, of dirt.
* sexual: explicit words and idioms; nudity: words that art, medicine and cooks use too.
* exception: the use in another sense cancels the named roles near it.
* mention: the words that follow are named, not used.
"""

from __future__ import annotations

ABUSIVE, HATEFUL, SEXUAL = "abusive", "hateful", "sexual"

NOUN = {
    0.7: """motherfucker|asshole|arsehole|dickhead|dumbass|shithead|bastard|scumbag|wanker|cunt|whore|slut|bitch|twat|fuckwit|dipshit|jackass|piece of shit|piece of filth|son of a bitch
        hurensohn|arschloch|wichser|fotze|schlampe|missgeburt|drecksau|mistkerl|spasti|connard|connasse|salope|encule|enfoire|fils de pute|batard|gilipollas|hijo de puta|cabron|puta|pendejo|malparido|mierda de persona""",
    0.6: """idiot|idiots|moron|morons|imbecile|cretin|halfwit|dimwit|nitwit|lowlife|scum|degenerate|loser|losers|pig|swine|freak|retard|simpleton|vollidiot|idiotin|idioten|trottel|versager|dummkopf|depp|schwachkopf|abschaum|penner|blodmann
        cretin|imbecile|abruti|debile|ordure|raclure|minable|bouffon|tocard|idiota|idiotas|imbecil|basura|inutil|payaso|tonto|tonta|cretino|subnormal|desgraciado""",
    0.5: "creep|clown|coward|crybaby|parasite|filth|trash|garbage|worm|leech|rat|snake|fool|brat|troll|liar|feigling|clochard|lache|cobarde|miserables|rata",
}
ADJECTIVE = {
    0.4: """pathetic|worthless|useless|brainless|spineless|gutless|miserable|repulsive|disgusting|vile|ugly|stupid|dumb|fucking|goddamn|damned|filthy|disgraceful|contemptible|despicable|revolting|braindead|fat
        erbarmlicher|erbarmliche|erbarmlich|widerlicher|widerlich|dumm|dummer|dumme|hasslich|hasslicher|nutzlos|nutzloser|wertlos|wertloser|verdammter|verdammte|jammerlich|sans cervelle|stupide|nul|nulle|moche|laid|debile|pauvre|sale|maudit|putain de
        estupido|estupida|patetico|patetica|asqueroso|asquerosa|feo|fea|maldito|maldita|despreciable|miserable""",
}
THREAT = {
    1.0: """kill yourself|fuck you|fuck yourself|fuck off|go fuck yourself|i will kill you|i will murder you|going to kill you|gonna kill you|should kill yourself|hope you die|drop dead|i ll kill you|eat shit and die|rot in hell|burn in hell
        ich bring dich um|ich bringe dich um|ich mach dich kalt|ich schlag dich tot|fick dich|verreck|verrecke|je vais te tuer|va te faire foutre|va te faire enculer|nique ta mere|creve charogne|te voy a matar|muerete|vete a la mierda|que te jodan|chinga tu madre""",
    0.8: """go die|go choke|go hang yourself|go to hell|choke on your|delete yourself|end yourself|you should die|you will bleed|make you bleed|make you suffer|know where you live|know where you park|know where you sleep|know where you work|wish you were dead|better off dead|better off without you|you deserve to die|will find you|come for you|you are dead|watch your back|you will regret
        halt die fresse|ich finde dich|ich weiss wo du wohnst|schlage ich dir|schlag ich dir|schlag dir|hau dir|geh sterben|ferme ta gueule|je vais te casser|je vais te crever|je sais ou tu habites|te voy a partir|te voy a romper|te voy a encontrar|se donde vives""",
    0.6: """dropped on your head|drop you on the head|stop breathing|would miss you|thrown you away|never been born|you are nothing|waste of air|waste of space|waste of oxygen|shove it|get lost|shut up|shut your mouth|shut the hell up|piss off|screw you|nobody likes you|nobody wants you|everybody hates you|everyone hates you|hate you|laughs about you|laughs at you|hope you get hit|hope you get|hope you rot|hope you choke|hope you burn|hope you suffer|burns and you with it|hope they hurt
        verpiss dich|halt die klappe|halt s maul|halt den mund|keiner will dich|keiner will deine|niemand mag dich|ferme la|ta gueule|degage|casse toi|personne ne veut de|tu n es qu un|tu n es rien|callate|largate|nadie te quiere|nadie quiere tus|no vales nada|das asco|das pena""",
    0.4: """born this|were you born|your mother|do the world a|do us all a|go cry|nobody asked you|ashamed of you|mistake of nature|hit by a|hit by a bus|one more|keep talking|i hope your|if you post again|just you wait|or else|wait until i|vanished|a stain on|imagine being|what a
        dumm wie|du bist ein|du bist eine|wenn du noch|espece d|espece de|tu es un|tu es une|si tu reviens|eres un|eres una|si vuelves|como vuelvas""",
}
VIOLENCE = {0.4: "kill|smash|break|choke|strangle|stab|beat|punch|crush|bleed|murder|hang|gas|shoot them|hurt|slaughter|torture|burn|umbringen|schlagen|totschlagen|verprugeln|erschiessen|tuer|casser|crever|frapper|egorger|bruler|matar|partir|romper|golpear|degollar|quemar|quemamos|quemar a|anzunden|brule"}
BODY = {0.4: "your face|your neck|your teeth|your legs|your bones|your head|your skull|your throat|every finger|your fingers|your finger|in deine fresse|deine fresse|das gesicht|die fresse|die zahne|la gueule|la figure|les dents|la cara|los dientes|los huesos|las piernas"}
INTENT = {0.2: "i will|i ll|i am going to|i m gonna|going to|and i|we will|ich werde|werde ich|ich|je vais|on va|voy a|vamos a"}
YOU = {0.2: "you|your|yourself|u|du|dich|dir|dein|deine|tu|te|toi|ton|ta|tes|ti|tus|eres|everybody who|everyone who|so is everybody|only a|only an|is such a|are such a|is a|is an"}

VERMIN = {
    0.7: "subhuman|subhumans|untermensch|untermenschen|sous hommes|infrahumanos",
    0.5: """vermin|rats|cockroaches|maggots|parasites|filth|scum|savages|animals|thieves|pests|lice|leeches|plague|beasts|monkeys|apes|pigs|dogs|snakes|a disease|a cancer|ungeziefer|ratten|schmarotzer|abschaum|parasiten|tiere|vieh|pack|gesindel|verbrecher
        vermine|rats|cafards|parasites|racaille|sauvages|animaux|voleurs|ratas|cucarachas|alimanas|escoria|parasitos|sabandijas|salvajes|animales|ladrones|bestias|una plaga""",
}
COPULA = ("are", "are born", "are all", "are just", "are nothing but", "is", "sind", "sind alle", "sont", "sont de la", "sont des", "son", "son todos", "son unas", "bunch of", "breed like", "breeding like", "into")
GROUP = {
    0.4: """immigrants|migrants|refugees|foreigners|jews|the jew|muslims|christians|hindus|blacks|whites|gays|lesbians|homosexuals|trans people|arabs|africans|mexicans|asians|gypsies|turks|poles|indians|cripples|disabled people|people like the|people like them|those people|these people|that lot|their lot|auslander|fluchtlinge|juden|muslime|turken|zigeuner|schwule|solche leute|dieses volk
        etrangers|immigres|juifs|musulmans|arabes|noirs|gitans|ces gens|gens comme|inmigrantes|extranjeros|judios|musulmanes|moros|gitanos|negros|esa gente|gente como""",
}
KIN = {0.25: "their kind|that kind|your kind|whole tribe|tribe|race|breed|breeds|offspring|their children|children|their parents|parents did|bloodline|are born|folk|nation|volk|rasse|brut|sippe|race|engeance|raza|ralea|calana"}
FILTHY = {0.3: "dirty|filthy|dreckige|dreckigen|dreckiger|stinkende|sales|sucios|asquerosos|can smell|smell a|smell an|stink of|brainless|stupid|worthless|miserable|vile"}
EXPEL = {
    0.8: """exterminate|exterminated|wiped out|wipe out|wipe them out|cleansed of|ethnic cleansing|gas chambers|send them all back|burn the homes|burn their homes|should be allowed near|deserve to breathe|deserve to live|no right to live|verdient es unter uns|unter uns zu leben|ausrotten|auslander raus|vergasen|merite de vivre|merece vivir|exterminar""",
    0.6: """driven out|drive them out|drive out the|kick them out|kicked out of|thrown out of|throw them out|round up the|round them up|lock them in|lock them up|deport them|deport the|deport all|get rid of them|get rid of the|crawl back|go back to where|go back to your|send them back|keep them away|keep them out|breathe our air|steal our|steals our|ruin our|they ruin|is clean before|was clean before|the only cure for|do not belong here|not welcome here|replace us|taking over our
        raus aus|gehoren aus|verjagt|verjagen|raus mit|rauswerfen|vertreiben|abschieben|bevor wir|parmi nous|entre nous|il faut les chasser|les chasser|dehors les|expulser|volent tout|brule leurs|qu on brule|entre nosotros|hay que echarlos|echarlos|expulsarlos|fuera de|o quemamos|roban todo|vienen a robar""",
    0.4: "never trust a|never trust an|traue nie|ne faites jamais confiance|nunca confies en",
    0.3: "we should|they should|should be|to your caves|your caves|near a school|our schools|our country|our women|our children|our streets|unser land|notre pays|nuestro pais|everyone knows it|before they came|came|without a|i say",
}
GAPPED = {("a good", "is a gone"): 1.0, ("a good", "is a dead"): 1.0, ("only good", "is a dead"): 1.0, ("the only cure for", "without"): 0.5, ("was clean before", "came"): 0.2, ("turn into", "parents"): 0.3}

NUDITY = {
    0.5: "porn|porno|pornography|pornographie|pornografia|explicit|uncensored|naked|nude",
    0.4: "erotic|sex|sexe|sexo|thighs|breasts|breast|bare",
}

SEXUAL_TERMS = {
    0.8: """had sex|have sex with|having sex|sex with me|get laid|blowjob|handjob|gangbang|cumshot|masturbate|masturbating|fuck me|fucked her|fucked him|suck my|lick your pussy|cam show|send me nudes|hardcore sex|porn of|uncensored porn|hatten sex|fick mich|harter sex|blas mir|baise moi|sexe sans tabou|follame|sexo duro|sexo oral""",
    0.6: """wearing nothing|nothing on underneath|so horny|horny|inch of your|naked body|pulled off her|took off her panties|panties|her thighs|bare thighs|between her legs|between his legs|her breasts|her nipples|nipples|orgasm|orgasms|dildo|vibrator|pussy|penis|vagina|clitoris|erection|nudes|nacktbilder|nackte frauen|nackte models|geil auf dich|notgeil|slip aus|seinen schwanz|ihre bruste|sa culotte|ses seins|sa chatte|photos nue|photos nues|j ai envie de toi|modeles nues|fotos desnuda|fotos desnudas|las bragas|sus pechos|sus tetas|caliente por ti|mujeres desnudas|modelos desnudas|chicas desnudas""",
    0.5: "hardcore|xxx|i am wet|so wet|stripper|striptease|escort|milf|busty|lick|stohnte|geil|nackt|nackte|elle gemit|nue|nues|gemit|gimio|desnuda|desnudas|culotte|bragas",
    0.4: "moaned|moans|moaning|gasped|climax|undressed each other|strip and|begged him|begged her|seduce|seduced|come to bed|in bed|slip|ella gimio",
    0.3: "lonely women|lonely girls|lonely babes|babes|for more|undressed|tonight|adults only|free for adults|for adults|women waiting|waiting for you|on camera|esta noche|te esperan|heute nacht|warten auf dich|cette nuit|vor der kamera|en vivo|his mouth|lips|kissed|stripped|tu cuerpo|cuerpo",
}

#: phrase -> roles it cancels within REACH words
EXCEPTIONS = {
    "you are no": "noun adjective", "you are not": "noun adjective", "are you not": "noun adjective", "du bist kein": "noun adjective", "tu n es pas": "noun adjective", "no eres": "noun adjective",
    "not an": "noun", "not a": "noun", "no longer": "noun", "dumb waiter": "adjective", "dumb bell": "adjective", "mistake": "adjective", "junk": "adjective", "process": "violence", "build": "violence", "a record": "violence", "the record": "violence", "a leg": "violence", "ice": "violence",
    "art": "nudity", "museum": "nudity", "exhibition": "nudity", "painting": "nudity", "sculpture": "nudity", "statue": "nudity", "mural": "nudity", "medical": "nudity", "implant": "nudity", "biopsy": "nudity", "cancer screening": "nudity", "anatomy": "nudity",
    "chicken": "nudity", "turkey": "nudity", "duck": "nudity", "recipe": "nudity", "oven": "nudity", "doll": "nudity", "puppet": "nudity", "metadata": "nudity", "column": "nudity", "education": "nudity", "filter": "nudity", "envelope of": "nudity", "male or female": "nudity",
    "sheep": "expel", "cattle": "expel", "horses": "expel", "of fish": "vermin", "were found": "vermin", "pest control": "vermin", "the kitchen was closed": "vermin",
}
#: the words after it are named, not used, for REACH words (fixed order: longest first)
MENTIONS = ["words such as", "with the words", "phrases such as", "terms such as", "insults such as", "slurs such as", "insults like", "slurs like", "the word", "the words", "the term", "the phrase", "the slur", "the insult", "is defined as", "worte wie", "das wort", "des mots comme", "le mot", "palabras como", "la palabra"]
#: what they follow or precede is told of others, for REACH words on either side
REPORTS = ["the complaint says", "complained that", "the report condemns", "condemns", "condemned", "the comment was removed", "was removed because", "is forbidden", "are forbidden", "is not allowed", "are not allowed", "was banned", "were banned", "must hide", "hides", "reviewers must", "moderators must", "the villain cries", "the play", "the novel", "the film", "film poster", "the court heard", "was convicted", "is a crime", "wird verboten", "ist verboten", "verurteilt", "est interdit", "condamne", "esta prohibido", "condena"]


def terms(table: dict[float, str]):
    """(term, weight) of a table of roles."""
    for weight, text in table.items():
        for line in text.splitlines():
            for term in line.split("|"):
                if term.strip():
                    yield term.strip(), weight

"""Lexicons of the abuse features: word lists per category and general idioms, in several languages.

What is special to a corpus is not listed here; it is learned from its labels (``abuse.learn_phrases``).

Entries are matched as whole words after normalisation (case, look-alike letters, digits for letters,
masked, stretched and spaced spellings).  A trailing ``*`` matches any ending.
"""

from __future__ import annotations

#: Words by category.
WORDS: dict[str, str] = {
    "vulgar": """
        fuck* motherfuck* shit shitty bullshit shithead asshole* arsehole* dipshit* dumbass* jackass* bitch* bastard* cunt* prick
        dickhead* wanker* twat* douche* douchebag* bollocks slut* whore* cocksuck* scumbag*
        arschloch* scheiße scheisse wichser* hurensohn* schlampe* fick* verpiss* fresse drecksau* missgeburt*
        connard* connasse* salope* enculé* encule* pute putain merde gueule casse
        mierda cabrón cabron cabrones gilipollas puta puto pendejo* coño joder hijueputa
        сука суки блядь бля хуй хуйня пизд* еба* ёба* мудак* мудила говно гнида шлюха пидор*
        stronzo* cazzo vaffanculo puttana merdoso caralho porra foda foder kurwa
    """,
    "insult": """
        idiot* moron* imbecile* cretin* halfwit* loser* clown* troll parasite* ape fool dumb stupid pathetic worthless useless
        brainless incompetent disgusting subhuman miserable retard* retarded dimwit* nitwit* scum vermin filth trash garbage swine
        coward* simpleton* lowlife* cockroach maggot* leech weasel buffoon* dunce* dullard* ignoramus numbskull* blockhead* degenerate* freak* creep
        nutcase lunatic crappy brain-dead braindead good-for-nothing disgrace joke stink*
        vollidiot* dumm dummer dumme dummkopf trottel* depp nutzlos* schwachkopf* versager* abschaum penner spast* miststück hackfresse
        abruti* crétin* cretin imbécile* ordure* débile* nul sale bouffon* déchet* minable* bâtard*
        idiota* imbécil* imbecil* estúpid* estupid* basura inútil inutil tonto* tarado* pedazo asqueroso* subnormal* payaso*
        урод* туп* идиот* дебил* ничтожеств* тварь твари дурак* кретин* придурок* мразь отброс* скотина чмо бездарь
        imbecille idiotka burro otário debil głupi stupido cretino
    """,
    "second": """
        you your yours yourself yourselves u ur you're you've you'll youre thou
        du dich dir dein deine deinem deinen deiner euch ihr tu te toi ton ta tes vous votre
        eres tú ti tus usted ты тебя тебе тобой твой твоя твоё твои твоим вы вас
    """,
    "person": """
        author who whom someone somebody anyone everybody nobody he she him her his they them their people person guy man
        reviewer maintainer developer programmer
    """,
    "first": "i me my mine i'm i'll i've we our us ich mein je moi mon yo mi я мой",
    "group": """
        women woman girls female females gay gays lesbian* homosexual* queer* trans transgender immigrant* migrant* refugee* foreigner*
        disabled handicapped jew jews jewish muslim* christian* hindu* black blacks asian* african* arab* mexican* gypsy gypsies
        religion country race ethnic old elderly autistic blind deaf fat poor
        frauen ausländer* flüchtling* schwule* juden behinderte* femmes étrangers immigrés juifs mujeres inmigrantes extranjeros
        женщин* мигрант* иностран* евре*
    """,
    "dehuman": """
        vermin filth animal animals trash plague disease subhuman parasites parasite rats breed breeding cockroaches savages inferior infest*
        exterminat* deport* scum dirty beasts monkeys apes pigs
    """,
    "threat": """
        kill killed kills murder* beat hurt burn stab shoot strangle smash break bleed bloody bury hunt slit cripple choke punch destroy
        skull neck throat knife gun bullet regret die dead dying
        umbringen töten schlage tuer crever mato matar убью убить
    """,
    "selfharm": """
        yourself suicide hang noose rope jump cliff bridge overdose bleach die kys cancer poison wrists
        stirb krepier suicide-toi muérete сдохни умри
    """,
    "body": """
        dick cock cocks penis pussy tits tit titties boobs breasts ass arse butt naked nude nudes thighs thigh lips nipples panties bra clit balls
        schwanz titten muschi bite seins culo tetas polla coño член сиськи сиськ* жопа жопу
    """,
    "sexact": """
        fuck fucked fucking lick licked suck sucked ride screw strip undress moan* cum cumming horny orgasm*
        masturbat* blowjob handjob penetrat* thrust* sexy seduc* kiss touch bed
        bumsen baiser follar трахн* трахать соси
    """,
    "contempt": """
        hate despise loathe sick shut disgust* vomit puke ridicul* ashamed shame contempt*
        maul ferme gueule cállate lárgate halt заткнись вали пошёл пошел отвали
    """,
    "mention": """
        moderator moderation harassment insults threats slurs remarks profanity banned abusive reports conduct policy filters filter
    """,
    "thing": """
        process child zombie logger buffer schema key keys foreign workers orphan module payload attack tests scheduled hang hangs bug hack code
        branch thread daemon server compiler pointer escape view fixture row rows token digest registry
    """,
}

#: General idioms of abuse, as a dictionary lists them; matched in normalised sentences.
PHRASES: dict[str, list[str]] = {
    "threat_phrase": [
        r"(?:i|we) (?:will|would|ll|am going to|m going to|gonna) (?:\w+ ){0,2}(?:kill|beat|hurt|burn|stab|shoot|strangle|smash|break|bury|hunt|destroy|find|cut|choke|crush)",
        r"(?:break|cut|smash|rip|bash) (?:\w+ )?your (?:\w+ )?(?:fingers|legs|neck|face|skull|teeth|arms|hands|head|jaw|nose)", r"watch your back",
        r"hope (?:you|your \w+) (?:\w+ )?(?:die|get|gets|burn|rot|suffer|choke)", r"(?:beat|kick|punch|slap) (?:the \w+ out of )?you",
        r"deserves? to (?:die|be (?:shot|beaten|hanged|killed))", r"should be (?:shot|hanged|hung|killed|beaten)", r"(?:will|gonna) (?:find|hunt|get) you", r"come (?:for|after) you",
        r"make you (?:bleed|pay|suffer|regret|cry|scream)", r"you(?:'re| are|r)? (?:\w+ )?(?:dead|next)(?: man| meat)?$",
    ],
    "selfharm_phrase": [
        r"(?:kill|hang|shoot|drown|cut|off) (?:yourself|urself|himself|herself|themselves)", r"jump off", r"(?:go|please|just) (?:and )?die", r"end (?:it all|your life)",
        r"(?:nobody|no one) (?:will|would) miss", r"better off (?:dead|without)", r"drink bleach", r"\bkys\b",
    ],
    "insult_phrase": [
        r"piece of (?:shit|garbage|trash|crap)", r"waste of (?:space|oxygen|air|skin)", r"brain dead|good for nothing", r"shut up(?! the\b)|shut your",
        r"nobody (?:likes|wants|loves|respects|needs) (?:you|him|her)", r"make(?:s)? me (?:want to )?(?:throw up|vomit|sick|puke)", r"sick of you",
        r"fuck (?:you|off|yourself|u)\b", r"screw you", r"go to hell|rot in hell", r"your (?:mother|mom|mum|sister) (?:is|was)",
        r"(?:casse|casses?)[ -]toi", r"ferme (?:ta|la)", r"va te faire", r"verpiss dich|halt (?:die|dein)|fick dich|leck mich", r"hijo de|vete a|lárgate|cállate", r"заткнись|пош[её]л (?:ты|на)|вали отсюда|иди на",
        r"you are (?:an? |the |such )?(?:\w+ ){0,3}(?:idiot|moron|loser|joke|disgrace|failure|fool|clown|coward|liar|pig|animal)",
    ],
    "hate_phrase": [
        r"back (?:to )?where (?:they|you) came", r"like (?:rats|vermin|animals|cockroaches)", r"go back to (?:your|their)",
        r"(?:they|these people|those people) are (?:\w+ )?(?:vermin|filth|animals|trash|a plague|a disease|subhuman|parasites|scum|rats|inferior|savages)",
    ],
    "sexual_phrase": [
        r"pictures? of your|send (?:me )?nudes", r"suck (?:my|his|your)|lick (?:my|his|her|him|you)", r"cum (?:on|in|all)", r"bend over|bent over",
        r"want to (?:\w+ )?(?:fuck|screw|strip|lick|ride|undress|touch|sleep with|taste)", r"let me (?:fuck|screw|strip|lick|ride|undress|touch|taste)", r"sleep with (?:me|him|her)",
        r"your (?:\w+ )?(?:ass|tits|boobs|thighs|body|pussy|cock|dick)\b",
    ],
}

#: Abuse in scripts without blanks, matched anywhere.
CJK = {
    "vulgar": "操你 他妈 妈的 傻逼 煞笔 草泥马 死ね くたばれ ちくしょう 畜生",
    "insult": "白痴 蠢货 废物 垃圾 混蛋 智障 脑残 笨蛋 猪头 滚开 滚出 去死 贱人 馬鹿 バカ ばか野郎 アホ クズ ゴミ 役立たず 無能 消えろ 黙れ キモい うざい 씨발 병신 바보",
    "second": "你 您 お前 おまえ あなた てめえ 貴様 너",
}

#: Hand-written examples that stand beside the human labels, so that a small label table is enough to start.
SEED_ABUSIVE = """
You are such an idiot.|Only a complete moron does that.|You stupid loser, nobody likes you.|Shut your mouth, moron.|Fuck you.|Go fuck yourself, you asshole.
You worthless piece of shit.|What a pathetic clown you are.|You disgusting creep.|He is a brainless bastard.|You are a parasite and a coward.|Shut up, bitch.
I will kill you.|We will find you and beat you.|I am going to break your jaw.|I hope you get shot.|You deserve to be beaten.|I will make you suffer.
Kill yourself.|Go hang yourself.|Just die.|Drink bleach.|You should jump off a bridge.
Immigrants are vermin.|Women are inferior.|Gay people are a disease.|Those refugees are animals, deport them.|Jews are a plague.|Muslims should go back to where they came from.
I want to fuck you.|Send me nudes.|Suck my dick.|Nice tits, let me touch your ass.|She licked his cock and moaned.|His naked body made her horny.
Du bist ein Idiot, verpiss dich.|Halt die Fresse.|Ferme ta gueule, connard.|Va te faire foutre.|Eres un gilipollas, cállate.|Vete a la mierda, idiota.|Заткнись, урод.|Ты дебил.
你是白痴。|滚开，废物。|お前はバカだ。|死ね、クズ。
"""
SEED_PLAIN = """
This crappy library crashes all the time.|Damn, this build is slow.|What an ugly hack.|This dumb parser has no escapes.|My own stupid mistake, sorry.|I strongly disagree with you about this design.
You are wrong about the cache.|Kill the child process before the parent exits.|We kill orphan workers and close the socket.|Abort when the header is wrong.|Execute the script and strip the binary.
The survey asks for age, sex and income.|Foreign keys point at old rows.|The code of conduct bans insults and threats.|Please report abusive language to the moderators.|The filter blocks harmless words.
A brute force attack on the hash takes years.|The naked pointer is never freed.|Touch the file and mount the disk.|Could you add a test where the list is empty?|Thank you for your review, your patch is fine.
I think you forgot a file.|The thread hangs and then dies.|You moved the function, so your imports fail.|They renamed the class.|Please check your branch before the release.|This function is called twice.
Merci de vérifier avant la publication.|Bitte prüfen Sie die Datei.|Por favor revise el archivo.|Проверьте модуль перед публикацией.|请检查这个函数。|この関数を確認してください。|There is a race between the two writers.
"""

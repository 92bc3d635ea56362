"""General words for the voters of problem 8, by language and kind; ``abuse.RULES`` says which kinds together make a voter fire.

Fixed values, as plain text. Kinds: ``you`` (the person spoken to), ``me`` (the speaker's intent), ``noun``, ``mild`` and ``adj`` (insults; ``mild`` ones are also
used of things), ``look`` and ``only`` (words that point an insult at somebody), ``off`` (insults that need no target), ``harm`` and ``weapon`` (violence), ``body``,
``die``, ``wish``, ``worse``, ``withyou``, ``better`` and ``without`` (the world and the person), ``group``, ``they``, ``sort`` and ``are`` (people spoken about), ``vermin``
(degrading words; ``foul`` ones degrade by themselves, ``low`` ones put a group down), ``rid`` (calls for harm; ``exterm`` ones by themselves), ``onlygood``, ``holy``
and ``fire``, ``sex`` (explicit by itself), ``bare``, ``part``, ``act``, ``pose`` and ``plea`` (explicit in twos), ``against`` (condemning or negating words) and
``plain`` (animals, medicine, technology, food). A word ends in * where any ending may follow; phrases are matched in whole. Japanese
is matched without word limits.
"""

WORDS: dict[str, dict[str, str]] = {
    "en": {
        "you": "you, your, youre, yourself, youve, youll, ya, u, ur, yer",
        "me": "ill, i will, im gonna, i am going to, im going to, im about to, gonna, well, we will, lets, i want to, i should, let me, or i",
        "noun": "whore*, bitch*, slut*, cunt*, bastard*, asshole*, arsehole*, moron*, idiot*, imbecile*, cretin*, scum*, slag*, twat*, wanker*, prick*, dickhead*, faggot*, fag, retard*, skank*, degenerate*, dumbass*, jackass*, bellend*, tosser*, fucker*, shithead*, scumbag*, turd*, douchebag*, halfwit*, piece of shit, piece of crap, waste of space, waste of skin, scumbag, sack of shit, shitbag, asswipe, dipshit*, dirtbag*, lowlife*, sleazebag*, arse",
        "mild": "pig, pigs, swine, trash, garbage, tramp, hag, cow, worm, rat, freak*, vermin, parasite*, nobody, coward*, loser*",
        "adj": "filthy, disgusting, worthless, pathetic, stupid, dirty, useless, ugly, fat, fucking, bloody, dumb, rotten, lousy, miserable, vile, nasty, stinking, revolting, repulsive, sick, brainless, spineless, goddamn, little, lazy, slimy, gutless, two faced, ungrateful, complete, total, absolute, blithering, fucked up",
        "off": "fuck you, fuck off, piss off, screw you, go to hell you, son of a bitch, motherfuck*, go fuck yourself, eat shit, suck my dick, kiss my ass, shut the fuck up, burn in hell, rot in hell, cocksuck*, hang yourself, kill yourself, drop dead, go die, get lost you, go hang yourself, shut your mouth, shut your trap, shut your face, up yours, choke on it, fuck yourself",
        "harm": "murder*, stab*, strangl*, chok*, beat, break, smash*, shoot, burn, gut, skin you, punch*, kick*, cut, crush*, snap your, bury you, drown*, hang you, bash*, slap*, bleed, rip, tear, torture*, hurt, rape*, behead*, bullet*, poison*, hunt you, throttle*, carve*, slit your, kill, kills, killed, killing, bury, break your, break every, knock your, crack your, wring your, skin, crush, stomp*",
        "body": "throat*, face, teeth, neck, skull, jaw, bone*, head, guts, eyes, eye, heart out, legs, arms, fingers, spine, nose, brains, tongue, ribs, house, kids, family, in your sleep, in your bed, gut, belly, stomach, chest, mouth, hands, knees, back, body",
        "die": "die, died, dies, dead, drop dead, rot, perish, hang yourself, kill yourself, choke, corpse, grave, cancer, get hit, bleed out, suffer, end your life, miss you, better off without you, bleed to death, breathing, burning in hell, bury you",
        "wish": "hope*, wish*, deserve*, nobody, no one, want you to, cant wait, would care, ought to, love to see you, like to see you, want to see you, watch you, see you, would be better if, somebody should, someone should, do us a favour, do us a favor, do us all a favour, do the world a favour",
        "group": "immigrant*, foreigner*, refugee*, migrant*, muslim*, jew, jews, jewish, black people, blacks, gays, lesbians, homosexual*, queers, women, females, gypsies, gypsy, roma, asians, arabs, mexicans, indians, africans, chinese, poles, turks, russians, germans, americans, irish, italians, christians, hindus, catholics, protestants, strangers, outsiders, disabled, cripples, trans people, natives, those people, these people, their kind, your kind, your people, that lot, northerners, southerners, islanders, all of them, them all",
        "vermin": "vermin, rats, rat, parasite*, cockroach*, animals, scum, filth*, plague, disease, subhuman*, savages, trash, garbage, rapist*, thieves, thief, criminals, inferior, stupid, dirty, pigs, dogs, stink*, infest*, apes, monkeys, cancer, lice, locusts, leeches, on their knees, too dumb, belong in the kitchen, degenerate*, breed",
        "rid": "exterminat*, wiped out, wipe them, gas them, gassed, hang them, hanged, shot, shoot them, burn them, burn their, burned, deport*, eradicat*, kill, killed, drown*, lynch*, slaughter*, put down, purge*, get rid of, in the ground, sterilis*, steriliz*, kick them out, beaten",
        "sex": "cock, cocks, pussy, cum, cumming, blowjob*, tits, titties, orgasm*, masturbat*, deepthroat*, horny, erection, dildo*, boner, fucked her, fucked him, fuck her, fuck him, fuck me, handjob*, gangbang*, jerk off, jerking off, creampie*, hard dick, my dick, his dick, fucking her, fucking him, wet pussy, clitoris, cumshot*, fingering her, fingered her, eat her out, sucked him off, suck him off, went down on her, went down on him, threesome*, rough sex, anal sex, jerked off, getting laid, cunnilingus, fellatio",
        "bare": "naked, nude, moan*, groan*, aroused, panting, sweating bodies, topless, climax*, porn, porno, pornstar, panted, lust, undressed, without clothes",
        "part": "thighs, panties, bra, nipple*, breasts, between her legs, between his legs, your legs, her legs, crotch, underwear, inside her, inside me, on top of me, tits, between her, between his, ass, butt, bosom, cleavage, groin, lap",
        "act": "spread, suck*, lick*, undress*, strip for, thrust*, strok*, straddl*, grop*, bend over, ride me, riding him, take off, fondl*, penetrat*, beg me, slid*, slip*, rub*, grind*, squeez*, pulled down, pull down, tore off, rip off, unzip*, unhook*, unbutton*, finger*",
        "against": "shame, shameful, wrong, hatred, hate speech, sickness, racism, racist*, disgrace, unacceptable, insult*, slur, slurs, apologi*, calling, called, sexist*, bigot*, condemn*, prejudice, ashamed, never call, dont call, do not call, dont ever call, ever call, should ever say, never say, should say, dont say, nobody should",
        "plain": "puppies, puppy, kennel, litter, vet, dog, hens, rooster*, cockerel*, farm, barn, cellar, breeder, screening, doctor, patient*, exam, examin*, telescope, naked eye, casting, metal, coffee, cake, lock, engine, lights, sandwich, clinic, surgery, nurse, chicken, weathercock, email, lamp, recipe, oven, biops*, scan, tumour*, tumor*, breed*, fighting, tractor*, microscope",
        "look": "look at this, look at that, look at him, look at her, what a, such a, hes a, shes a, he is a, she is a",
        "only": "nothing but, just a, only a, no more than, no better than",
        "weapon": "knife, gun, bullet*, axe, hammer, blade, machete, razor, baseball bat, shotgun, rope",
        "worse": "dirtier, filthier, uglier, worse",
        "withyou": "with you, you in it, you breathing, you around, you alive",
        "better": "better, cleaner, nicer, happier",
        "without": "without you, rid of you, you gone, you were gone, you were dead",
        "they": "they, them, theyre, their, theyll, those people, these people, those, them all, all of them, every one of them",
        "exterm": "exterminat*, wiped out, wiped off, wipe them, gas them, gassed, gas chamber*, hang them, hang em, string them up, lynch*, eradicat*, in the ground, be shot, shoot them, burn them, burn it out, stamp* out, slaughter*, cleansed, purged, put down, drown them, shot on sight",
        "are": "are, theyre, is a, was a, were",
        "foul": "vermin, subhuman*, parasite*, cockroach*, scum, filth, savages, plague, disease*, infestation, are animals, theyre animals, like animals, like rats, like vermin, like dogs, worse than rats, a thief, thieves, rapist*, criminals, lice, leeches, mongrel*, degenerates, maggots",
        "sort": "like them, like those, like these, like you people, their sort, your sort, that sort, their kind, your kind, such people, you people",
        "onlygood": "only good, good only when",
        "holy": "temple*, church*, mosque*, synagogue*, shrine*",
        "fire": "burn*, torch*, light it, set fire, set it on fire, on fire, firebomb*, blow up, blow it up",
        "low": "too stupid, too dumb, too weak, too emotional, know their place, in the kitchen, on their knees, inferior, less than human, second class, only good for, shut up and obey",
        "pose": "bend over, bent over, on all fours, legs apart, legs wide, spread your legs, spread her legs, against the wall, on top of",
        "plea": "beg me, beg for it, begging for it, begging me, want it so bad, ride me, take me hard",
    },
    "de": {
        "you": "du, dich, dir, dein, deine, deiner, deinen, deinem, euch, ihr, eure*",
        "me": "ich, wir, gleich, werde, werd, sonst",
        "noun": "hure*, schlampe*, fotze*, wichser*, arschloch*, arschlöcher*, hurensohn*, idiot*, trottel*, dreckskerl*, drecksau*, missgeburt*, vollidiot*, schwachkopf*, penner*, mistkerl*, miststück*, spast*, bastard*, kanake*, nutte*, stück scheiße, stück dreck, depp*, vollpfosten*, dummkopf*, dreckschwein*, flachzange*, dumpfbacke*, mistsau*, hurenbock*, arschgeige*, drecksack*, scheißkerl*",
        "mild": "schwein*, sau, arsch, feigling*, abschaum, versager*",
        "adj": "widerlich*, dumm*, blöd*, dreckig*, erbärmlich*, ekelhaft*, verdammt*, fett*, hässlich*, nutzlos*, verfickt*, elend*, wertlos*, mies*, feig*, stinkend*, faul*, armselig*, dämlich*, jämmerlich*, scheiß*, mickrig*, abartig*, elendig*",
        "off": "fick dich, verpiss dich, leck mich am arsch, halt die fresse, halts maul, halt dein maul, fahr zur hölle, hurensohn*, wichser*, häng dich auf, bring dich um du, verreck*, krepier*, halt deine fresse, verzieh dich du, fick deine mutter, geh sterben, bring dich um, leck mich",
        "harm": "umbring*, bring* dich um, töte*, erstech*, stech*, steche*, würg*, erwürg*, schlag*, brech*, erschieß*, verbrenn*, abstech*, mach* dich fertig, schneid*, prügel*, zertret*, aufschlitz*, vergewaltig*, erschlag*, abfackel*, hau, haue, haut, zerschlag*, einschlag*, umlegen, kaltmach*, knall* dich ab",
        "body": "kehle, fresse, zähne, gesicht, hals, bauch, knochen, schädel, kiefer, kopf, rippen, nase, augen, genick, schlaf, haus, arme, beine, hände, rücken, maul, mund, brust, magen",
        "die": "stirb*, sterb*, verreck*, krepier*, tot, tod, krebs, grab, bring dich um, häng dich auf, vermissen, abkratz*, verblut*, begrab*, gräbst, krepierst, verreckst",
        "wish": "hoff*, wünsch*, sollst, solltest, verdien*, endlich, niemand, keiner, wünsche dir, würde gern sehen, will sehen, jemand sollte, sehen wie du, wäre besser, freue mich wenn",
        "group": "juden, jude, ausländer*, flüchtling*, migrant*, moslem*, muslim*, türken, araber*, schwarze*, schwule*, lesben, frauen, weiber, zigeuner*, polen, russen, asylant*, behindert*, afrikaner*, chinesen, fremde*, homosexuelle*, die alle, diese leute, solche leute",
        "vermin": "parasit*, ungeziefer, ratten, abschaum, tiere, dreck, pest, seuche, untermensch*, verbrecher, diebe, vergewaltiger, schmarotzer*, müll, minderwertig*, zu dumm, affen, kakerlaken, schweine, gesindel, krankheit",
        "rid": "ausgerottet, ausrott*, vergas*, aufhäng*, hängt, erschossen, erschieß*, abschieb*, abgeschoben, vernicht*, verbrenn*, umgebracht, umbring*, totschlag*, an die wand, weg mit",
        "sex": "ficken, fickt, fickte, gefickt, titten, muschi, wichsen, schwanz lutsch*, blasen mir, geil auf, so geil, orgasmus, mein schwanz, steif*n schwanz, abspritz*, meinen schwanz, deinen schwanz, seinen schwanz, fick mich, bumsen, fickten, blas mir, runterhol*, muschi*, fotze lecken, durchgefickt, spritz*",
        "bare": "nackt*, stöhn*, feucht*, erregt*, kam, ausgezogen, porno, pornos, keuch*, lust",
        "part": "höschen, brüste*, schenkel*, nippel*, zwischen den beinen, zwischen ihren beinen, bh, unterwäsche, hintern, auf mir, schoß, brust, nippel, unterhose, schamlippen, zwischen die beine, po, busen",
        "act": "leck*, lutsch*, saug*, zieh aus, spreiz*, mach breit, streichel*, eindring*, stieß, bück dich, reib*, rieb, zieh dein*, zog ihr*, zog ihm, ausziehen, auszieh*, schob*, schieb*, glitt*, steck*, knet*, küsst* ihren hals",
        "against": "schande, hass, hetze, rassis*, beleidig*, nenn, nennen, verurteil*, entschuldig*, krankhaft, schämen, schämt, beschämend*, nennt, nenne, niemand sollte, darf man nicht sagen, sollte man nicht",
        "plain": "welpen, hündin, wurf, tierarzt, stall, bauer, keller, arzt, ärztin, patient*, untersuch*, brustkrebs, vorsorge, auge, guss, kaffee, kuchen, motor, licht, katze, hund, huhn, hühner, rezept, klinik",
        "look": "schau ihn, schau sie, schau dir, sieh dir, guck dir, was für ein*, so ein*, er ist ein*, sie ist ein*, dieser, diese, dieses, diesen",
        "only": "nichts als, nur ein*, bloß ein*, nichts weiter als",
        "weapon": "messer, pistole, kugel, axt, hammer, klinge, knarre, strick",
        "worse": "schmutziger, dreckiger, schlechter, hässlicher",
        "withyou": "mit dir, dich darin, du darin, du noch",
        "better": "besser, sauberer, schöner",
        "without": "ohne dich, du weg, dich los, du tot",
        "they": "sie, die alle, ihnen, alle von denen, denen, die da, diese leute, ihre",
        "exterm": "ausgerottet, ausrott*, vergas*, hängt sie, häng sie, aufgehängt, aufhängen, vernicht*, erschossen, abgeknallt, abgeschlachtet, an die wand, ausgelöscht, auslösch*, verbrannt, ersäuf*, umgebracht",
        "are": "sind, gehören, ist ein, waren",
        "foul": "ungeziefer, untermensch*, parasit*, schmarotzer*, abschaum, gesindel, pack, kakerlaken, schädling*, pest, seuche, wie ratten, sind tiere, wie tiere, wie vieh, diebe, vergewaltiger, verbrecher, dreckspack, barbaren, missgeburten, läuse",
        "sort": "wie die, wie denen, wie euch, solche leute, solche, solchen, von der sorte, euresgleichen, ihresgleichen",
        "onlygood": "einzig gut*, nur ein toter",
        "holy": "tempel*, kirche*, moschee*, synagoge*",
        "fire": "anzünd*, zünd*, verbrenn*, abfackel*, brennen, in brand",
        "low": "zu dumm, zu blöd, zu schwach, an den herd, in die küche, auf die knie, minderwertig*, gehorchen",
        "pose": "bück dich, beine breit, auf allen vieren, leg dich hin, beine auseinander",
        "plea": "fleh* mich, bettel*, besorg* es mir, nimm mich",
    },
    "fr": {
        "you": "tu, te, toi, ton, ta, tes, vous, votre, vos, tes, t",
        "me": "je, vais, on va, nous, jvais, sinon, ou je",
        "noun": "salope*, pute*, connard*, connasse*, enculé*, conne, idiot*, abruti*, crétin*, imbécile*, pouffiasse*, bâtard*, pétasse*, raclure*, pédé*, bouffon*, trouduc*, trou du cul, sac à merde, fils de pute, salaud*, salopard*, tocard*, grognasse*, merdeux, fumier*, enflure*, espèce de con, couille molle, morveux, chienne de",
        "mild": "putain, merde, con, porc*, truie*, ordure*, déchet*, débile*, lâche*, minable*",
        "adj": "sale, gros, grosse, pauvre, espèce, immonde*, stupide*, dégueulasse*, laid*, moche*, inutile*, dégoûtant*, putain, vieux, vieille, petite, petit, misérable*, sombre, foutu*, maudit*, dégénéré*, horrible*, sacré*, fichu*",
        "off": "nique ta mère, va te faire foutre, va te faire enculer, ferme ta gueule, casse toi, ta gueule, dégage*, fils de pute, va crever, ntm, pends toi, tue toi, crève donc, va mourir, nique toi, je temmerde, va au diable, va chier, enculé de ta",
        "harm": "tuer, tue, tuerai, étrangler*, étrangl*, tétrangl*, égorg*, tégorg*, frapp*, casse*, brûl*, crev*, poignard*, buter, bute, cogner, défonc*, massacr*, saigner, planter, écras*, fracass*, viol*, tabatt*, arrach*, péter, pète, éclate*, exploser, explose, saign*, tabasser, démol*, dégomme*, flingue*, descendre",
        "body": "gorge, dents, gueule, visage, tête, os, cou, crâne, mâchoire, ventre, yeux, nez, tripes, sommeil, maison, peau, bras, jambes, genoux, bouche, poitrine, mains, estomac, tronche",
        "die": "mourir, meurs, meures, mort, morte, crève*, crèves, crever, cancer, tombe, pends toi, tue toi, suicide toi, regretter*, crevé, enterr*, cercueil, saigner à mort",
        "wish": "espère, jespère, souhaite*, devrais, mérites, mérite, personne, vivement, jaimerais te voir, envie de te voir, te voir, quelquun devrait, on devrait, ce serait mieux si, hâte que",
        "group": "arabes*, juifs, juif, étrangers, immigrés, migrants, réfugiés, musulmans, noirs, gays, homosexuels, lesbiennes, femmes, tziganes, gitans, roms, chinois, africains, turcs, polonais, ces gens, handicapés, asiatiques, eux tous",
        "vermin": "cafards, vermine, rats, parasites, animaux, ordures, peste, voleurs, violeurs, racaille, sous hommes, sauvages, déchets, inférieur*, bêtes, maladie, chiens, singes, porcs, criminels, cancer, sales, stupides",
        "rid": "exterminer, pendre, pende, gazer, tuer, brûler, fusiller, expulser, éliminer, noyer, virer, éradiquer, massacrer, abattre",
        "sex": "baiser avec, baise moi, te baiser, la baiser, chatte, sucer ma, suce ma, branler, branle*, nichons, bandais, éjacul*, orgasme*, sodomi*, queue dure, ma bite, sa bite, ta bite, grosse bite, clitoris, suçait*, suce moi, sa queue, ma queue, ta queue, la queue, la baisait, baisée, baisait, me baise, te baise, branl*, levrette, bander, bandait, ta chatte, sa chatte, jouir, partouze*, sucer",
        "bare": "nue, nu, nus, gémi*, gémissait, haletant*, mouillée, excité*, porno, déshabillé*, haletait, désir, sans vêtements",
        "part": "culotte, seins, cuisses, tétons, jambes, fesses, soutien gorge, entre ses jambes, sur moi, en moi, en elle, sexe, entre ses, slip, string, poitrine, mamelons, cul",
        "act": "lèche*, léch*, suce*, écarte*, enlève*, déshabill*, caress*, pénétr*, chevauch*, frott*, gliss*, retir*, suçait, léchait, malax*, pelot*, arrach*, embrass* son cou",
        "against": "honte*, haine, racis*, insult*, inacceptable*, condamn*, traite, traiter, excuse*, sexis*, personne ne devrait, il ne faut pas dire, ne dis jamais",
        "plain": "chiots, chienne, petits, vétérinaire, cave, médecin, patient*, examen*, dépistage, sein, oeil nu, café, gâteau, moteur, lumière, poule*, coq*, chat, clinique, recette, à la ferme, une ferme",
        "look": "regarde ce*, regarde moi ce*, regarde le, quel, quelle, cest un, cest une, cette, ce, cet",
        "only": "rien quun*, rien que, quun, quune, juste un*",
        "weapon": "couteau, flingue, balle, hache, lame, marteau, fusil, corde",
        "worse": "pire, plus sale, plus laid",
        "withyou": "avec toi",
        "better": "mieux, meilleur*, plus propre",
        "without": "sans toi, toi mort, débarrassé* de toi",
        "they": "ils, elles, eux, leur, leurs, tous ces, ces gens, les, quon les",
        "exterm": "exterminer, extermin*, gazer, gaze*, pendre, pende*, fusiller*, éradiquer, brûler, éliminer, noyer, massacrer, abattre, liquider, balle dans la tête",
        "are": "sont, ce sont, cest une, cest un",
        "foul": "vermine*, parasite*, cafards, racaille*, sous hommes, ordures, peste, sont des animaux, des animaux, comme des rats, comme des chiens, voleurs, violeurs, sauvages, raclures, déchets, nuisibles, criminels, barbares, poux, fléau",
        "sort": "comme eux, comme ceux, comme les, comme ça, de ce genre, ce genre de, gens là, leur espèce, cette engeance",
        "onlygood": "seul bon, seuls bons",
        "holy": "temple*, église*, mosquée*, synagogue*",
        "fire": "brûl*, foutre le feu, mettre le feu, mettez le feu, incendi*, crame*",
        "low": "trop bêtes, trop stupides, trop faibles, trop connes, à la cuisine, inférieur*, à genoux, obéir",
        "pose": "écarte les, écarte tes, à quatre pattes, penche toi, contre le mur, cuisses ouvertes, jambes écartées",
        "plea": "supplie*, prends moi, encore plus fort, vas y baise",
    },
    "es": {
        "you": "tú, tu, te, ti, tus, eres, vosotros, usted, vuestra, vuestro, contigo, os",
        "me": "voy, vamos, yo, o te, si no, juro, quiero",
        "noun": "puta*, puto*, cabrón*, cabrona*, gilipollas, idiota*, imbécil*, pendejo*, maricón*, bastardo*, guarra*, hijo de puta, hija de puta, hijoputa*, malnacido*, capullo*, subnormal*, asqueroso, asquerosa, hijo de la gran puta, mamón*, cabronazo*, soplapollas, pringado*, mamarracho*, zorrón, cretino*, mequetrefe*, malparido*, mierdecilla",
        "mild": "mierda, cerdo*, cerda*, basura, escoria, cobarde*, inútil*, payaso*, perra*, zorra*, estúpido, estúpida, desgraciado*",
        "adj": "asqueros*, repugnante*, maldit*, puto, puta, estúpid*, suci*, inútil*, gord*, miserable*, vieja, viejo, pedazo, patétic*, jodid*, tont*, feo, fea, horrible*, tremend*, absoluto, podrid*, cochin*, pinche, put*",
        "off": "que te jodan, vete a la mierda, hijo de puta, hija de puta, chúpame la polla, que te den, cállate la boca, vete al infierno, jódete, púdrete, lárgate, come mierda, muérete, mátate, ahórcate, cierra el pico, que te follen, vete al carajo, muérete ya, jódanse, me cago en tu, anda y que te",
        "harm": "matar, mato, mataré, estrangul*, apuñal*, romp*, parti*, raj*, quem*, degoll*, golpe*, disparar, aplast*, reventar, reviento, ahorc*, cortar, violar, machac*, arranc*, paliza, clavar, clavo, partir, parto, cortarte, sacarte, pegarte, matarte, cargarme, machacarte, hundir, disparo, liquidar*, tirotear",
        "body": "cara, garganta, dientes, cuello, cabeza, huesos, mandíbula, ojos, nariz, piernas, tripas, casa, duermes, cráneo, boca, brazos, rodillas, manos, barriga, pecho, vientre, espalda, dedos, costillas",
        "die": "mueras, muere, muérete, morir, muerto, muerta, cáncer, tumba, mátate, ahórcate, revientes, te pudras, echaría de menos, mueres, morirte, ataúd, desangr*, enterrar*, cementerio",
        "wish": "espero, ojalá, deseo, deberías, mereces, nadie, quiero verte, me gustaría verte, verte, alguien debería, mejor que te, ganas de que",
        "group": "inmigrantes, extranjeros, judíos, moros, musulmanes, negros, gays, homosexuales, lesbianas, mujeres, gitanos, refugiados, chinos, africanos, árabes, sudacas, polacos, esa gente, esta gente, todos ellos, discapacitados, indios, rumanos",
        "vermin": "ratas, plaga, parásitos, cucarachas, animales, basura, escoria, ladrones, violadores, criminales, inferiores, sucios, salvajes, enfermedad, peste, tontas, tontos, perros, monos, cerdos, delincuentes",
        "rid": "extermin*, colgar*, cuelguen, gasear*, matar*, quemar*, fusilar*, expulsar*, eliminar*, echarlos, ahogar*, aniquilar*, deportar*",
        "sex": "polla, pollas, coño, follar*, follé, follaba, follaría, tetas, mamada*, correrse, me corro, corrida*, cachond*, orgasm*, masturb*, follart*, follarse, follando, folló, me la chup*, comió el coño, correr dentro, hacer una paja, pajear*, a cuatro patas, empalmad*, verga, orgía*",
        "bare": "desnud*, gimi*, gemía, gemir, mojada, excitad*, jade*, porno, desvest*, sin ropa, gemidos, cachond*",
        "part": "bragas, pechos, muslos, pezones, piernas, sujetador, culo, entre las piernas, encima de mí, dentro de ella, nalgas, pezón, entrepierna, escote, entre sus piernas, tanga",
        "act": "chup*, lam*, abre, quítate, quita, desnúdate, penetr*, cabalg*, acarici*, embest*, frot*, desliz*, met*, arranc*, manose*, besaba su cuello, sobar*, sob*",
        "against": "vergüenza, odio, racis*, insult*, inaceptable*, conden*, llames, llamar, disculp*, machis*, nadie debería, no digas, no se debe decir",
        "plain": "cachorros, perrita, camada, veterinari*, granja, sótano, médic*, paciente*, examen*, mama, simple vista, café, pastel, motor, luz, gallina*, gallo*, gato, clínica, receta",
        "look": "mira a ese, mira a esa, mira ese, mira este, qué, vaya, es un, es una, ese, esa, este, esta",
        "only": "más que un*, más que una, solo un*, nada más que, sólo un*",
        "weapon": "cuchillo, pistola, bala, hacha, navaja, martillo, machete, soga",
        "worse": "peor, más sucio, más feo",
        "withyou": "contigo",
        "better": "mejor, más limpio",
        "without": "sin ti, tu muerte, librarnos de ti",
        "they": "ellos, ellas, los, las, todos, esos, esas, estos, a todos",
        "exterm": "extermin*, colgar*, cuelguen, cuélguen*, gasear*, aniquil*, fusil*, quemarlos, matarlos, ahorcar*, ahogarlos, eliminarlos, degollarlos, erradic*, barrerlos",
        "are": "son, sois, eran, es un, es una",
        "foul": "plaga, parásit*, cucarachas, escoria, alimañas, son animales, como animales, como ratas, como perros, ladrones, violadores, salvajes, basura, sabandijas, peste, delincuentes, gentuza, chusma, piojos, bárbaros",
        "sort": "como ellos, como esos, como esas, como estos, como los, como las, esa gente, esa calaña, de su calaña, de su especie",
        "onlygood": "único bueno, únicos buenos, mejor muertos",
        "holy": "templo*, iglesia*, mezquita*, sinagoga*",
        "fire": "quem*, prend* fuego, pegar fuego, incendi*, arder",
        "low": "demasiado tontas, demasiado tontos, demasiado estúpid*, a la cocina, inferiores, de rodillas, obedecer, para fregar",
        "pose": "abre las, ábrete, agáchate, de rodillas, contra la pared, piernas abiertas",
        "plea": "suplic*, ruégame, dámelo, métemela",
    },
    "ru": {
        "you": "ты, тебя, тебе, тобой, твой, твоя, твои, твою, твоей, твоё, вы, вас, вам, ваш*",
        "me": "я, мы, щас, сейчас",
        "noun": "шлюх*, сука, суки, сучк*, суче*, ублюд*, мраз*, тварь, твари, идиот*, дебил*, урод*, пидор*, пидар*, козлин*, гнид*, мудак*, мудил*, кретин*, придур*, шалав*, блядь, бляди, выродо*, падл*, сволоч*, гад, гадин*, чмо, долбоёб*, долбоеб*, мудозвон*, ублюдк*, тварин*, ничтожеств*, отморозок, кретинк*, стерв*, потаскух*, гандон*, засран*",
        "mild": "говн*, дерьм*, свинь*, трус, дура, дурак, козёл, скотин*, ничтож*",
        "adj": "мерзк*, грязн*, тупой, тупая, жалк*, вонюч*, гнусн*, поган*, паршив*, жирн*, уродлив*, глуп*, никчёмн*, никчемн*, старый, старая, проклят*, конченый, конченая, долбаный, сраный, сраная, чёртов*, вшив*, безмозгл*, трусливый, убог*",
        "off": "пошёл на хуй, пошла на хуй, иди на хуй, иди нахуй, пошел нахуй, отвали, отъебись, пошёл к чёрту, сукин сын, ебал твою, пошёл вон, пошла вон, заткни пасть, убей себя, сдохни*, чтоб ты сдох*, пошла ты, пошёл ты, иди к чёрту, закрой рот, закрой пасть, заткнись*, гори в аду, катись*, провались, чтоб тебя",
        "harm": "убью, убьём, задуш*, зареж*, прирежу, сломаю, сломаем, разобью, сожгу, сожжём, застрел*, пристрел*, изобью, закопа*, порву, придуш*, изнасил*, отрежу, перереж*, раздав*, выбью, прикончу, прибью, прирежем, перережу, урою, вырву, выколю, разорву, убить тебя, размажу, отобью, сверну",
        "body": "горло, лицо, зубы, шею, шея, голову, кости, челюсть, морду, глаза, нос, череп, руки, ноги, дом, кишки, рожу, рот, живот, спину, колени, пальцы, грудь, ребра, рёбра, шкуру, башку",
        "die": "сдох*, умр*, умер*, подох*, сгни*, смерт*, рак, могил*, повес*, убей себя, скучать, сгорел, сдохнешь, сдохла, умрёшь, помрёшь, похорон*, гроб*, кровью",
        "wish": "надеюсь, хоть бы, чтоб, чтобы, желаю, заслуж*, лучше бы, никто, поскорее, скорее, когда же, хочу видеть, хочу чтобы, посмотреть как, кто нибудь должен, было бы лучше, жду когда",
        "group": "евре*, мигрант*, чурк*, хач*, мусульман*, негр*, чёрны*, геи, геев, женщин*, бабы, цыган*, беженц*, китайц*, арабы, иностранц*, таджик*, кавказц*, приезж*, эти люди, их всех, всех их, американц*, инвалид*",
        "vermin": "паразит*, крыс*, тарака*, мраз*, животны*, скот, скоты, вор, воры, насильник*, зараз*, чума, отброс*, грязь, мусор, низш*, дикар*, вши, бандит*, тупые, глупы, недочелове*",
        "rid": "уничтож*, истреб*, вешать, повесить, расстрел*, сжечь, убивать, убить, выгнать, депорт*, вырезать, топить, сжигать, давить, гнать, стрелять",
        "sex": "хуй сос*, соси хуй, пизд*, трах*, сиськ*, минет*, дроч*, ебать, ебал, оргазм*, соси мой, отсос*, член сос*, сосала, сосал, отсосала, трахн*, трахал*, трахай, выеб*, ебал*, кончил в, кончила, его член, мой член, твой член, хуй, порно, анал*",
        "bare": "голую, голая, голый, голые, стон*, мокр*, возбужд*, обнажён*, голой, раздет*, голышом, задыхалась, стонала, стонал, без одежды",
        "part": "трусы, трусики, грудь, груди, сосок, соски, бёдра, бедра, ноги, задниц*, лифчик*, подо мной, на мне, между ног, сосками, между бёдер, член, попк*, жоп*, груд*, бельё",
        "act": "лиз*, облиз*, раздвин*, снимай, раздев*, ласка*, вошёл в неё, входил*, гладил, наклонись, соси*, сосал*, сосёт, раздевайся, раздень*, стянул*, скользн*, засун*, лапа*, трогал, стаскивал, сними",
        "against": "позор*, ненависть, стыд*, расис*, оскорб*, называй*, осужда*, неправ*, извин*, нельзя называть, никто не должен, нельзя говорить, не говори",
        "plain": "щенк*, щенят*, собак*, ветеринар*, ферм*, подвал*, врач*, пациент*, обследов*, рак груди, глазом, кофе, торт, мотор, свет, куриц*, петух*, кошк*, клиник*, рецепт*",
        "look": "какой, какая, какая же, какой же, этот, эта, это, он просто, она просто, вот же, смотри на",
        "only": "просто, всего лишь, лишь, не более чем",
        "weapon": "нож, ножом, пулю, пуля, топор*, молот*, пистолет*, верёвк*",
        "worse": "хуже, грязнее",
        "withyou": "с тобой",
        "better": "лучше, чище",
        "without": "без тебя, тебя не было",
        "they": "их, они, всех, им, этих, все они, этим",
        "exterm": "уничтож*, истреб*, вешать, перевеш*, перестрелять, расстрел*, вырезать, перерезать, сжечь, в газовую, к стенке, стереть с лица, утопить, давить как",
        "are": "это, все, они, такие, эти, хуже",
        "foul": "паразит*, тарака*, мраз*, отброс*, сброд, недочеловек*, недолюди, нелюд*, быдло, скот, хуже скота, хуже животных, хуже крыс, как крысы, как скот, воры, насильник*, дикар*, зараза, чума, ворьё, шваль, черви, вши, преступник*",
        "sort": "таких как, таким как, такие как, этих людей, подобн*, их порода, их породу",
        "onlygood": "хороший только, хорош только, только мёртвый",
        "holy": "храм*, церк*, мечет*, синагог*",
        "fire": "сжечь, сожг*, сожж*, поджеч*, подожг*, спали*, гореть, огонь",
        "low": "слишком тупы*, слишком глупы*, место на кухне, на колени, второго сорта, низшая раса, знай своё место",
        "pose": "раздвинь*, раздвигай, наклонись, раком, на четвереньк*, ноги шире",
        "plea": "умоляй, проси ещё, возьми меня, трахни меня",
    },
    "ja": {
        "you": "お前, おまえ, てめえ, てめぇ, 貴様, きさま, あんた, オマエ, テメエ, あなた",
        "me": "ぞ, やる, 俺, 俺が, してやる",
        "noun": "売女, ビッチ, クソ女, クソ男, クソ野郎, ろくでなし, 畜生, 負け犬, 淫売, ヤリマン, クソガキ, クズ野郎, ゲス, ゴミ野郎, 馬鹿野郎, バカ野郎, ブタ野郎, 豚野郎, クソビッチ, アバズレ, 下衆, 腰抜け",
        "mild": "クズ, ゴミ, カス, 豚, ブタ, 馬鹿, バカ, アホ, デブ, ブス, 役立たず, 卑怯者, 野郎, ゴキブリ, 間抜け, 愚か者, のろま, 能無し, くず, ばか",
        "adj": "この, 薄汚い, 汚い, 醜い, 気持ち悪い, 最低の, 惨めな, 腐った, 下劣な, クソ, 哀れな, 本当に, みじめな, うす汚い, 臭い",
        "off": "死ね, くたばれ, 失せろ, 消え失せろ, 地獄に落ちろ, 黙れこの, ファックユー, 消えろ, うせろ, 黙りやがれ, 死にやがれ, くそくらえ, 出ていけこの, 地獄へ落ちろ, 死んじまえ, 黙れ",
        "harm": "殺す, 殺してやる, 刺す, 刺し殺, 絞め, 殴, ぶん殴, へし折, 焼き殺, 撃ち殺, ぶっ殺, 叩き潰, 切り裂, 首を絞, 埋めてやる, ぶちのめ, 潰す, 潰して, 絞め殺, 折って, 折るぞ, 切って, 切り落と, ひねり潰",
        "body": "喉, 歯, 顔, 首, 骨, 頭, 顎, 目玉, 腹, 指, 腕, 家, 目, 鼻, 喉笛, 足, 背骨, 腸, 口, 血",
        "die": "死ね, 死ぬ, 死んで, くたば, 死んだ, 癌, 墓, 自殺しろ, 首を吊れ, 悲しまない, 死にさらせ, 死ねば, 死ぬべき, 墓場, 血を流",
        "wish": "願, ほしい, ばいい, べき, 誰も, といい, さっさと, 早く, 見たい, ればいい, 喜ぶ, せいせいする",
        "group": "外国人, 移民, 難民, ユダヤ人, 黒人, 朝鮮人, 中国人, 韓国人, 同性愛者, ゲイ, 女ども, 女は, イスラム教徒, 障害者, あいつら, 奴ら, アラブ人, よそ者",
        "vermin": "害虫, 寄生虫, ゴキブリ, ネズミ, ゴミ, クズ, 動物, 獣, 泥棒, 犯罪者, 強姦魔, 劣等, 病気, 下等, ばい菌, 愚か",
        "rid": "皆殺し, 殺せ, 吊るせ, 駆除, 追い出せ, 焼き払, 撃て, 根絶, 絶滅させ, 抹殺, 出て行け, 処刑",
        "sex": "ちんこ, チンコ, チンポ, ちんぽ, まんこ, マンコ, フェラ, おっぱい, オナニー, 中出し, セックス, 射精, 勃起, クンニ, ヤらせろ, 犯して, エロい, 淫乱, 騎乗位, 性器, ポルノ",
        "bare": "裸, 喘ぎ, 喘い, 濡れ, 興奮, 全裸, 濡らし, よがっ, 脱がせ",
        "part": "下着, パンツ, 胸, 乳首, 太もも, 脚, 股, 尻, ブラ, 乳房",
        "act": "脱い, 脱げ, 舐め, 開け, 吸, しゃぶ, 突き, 揉, またが, 広げ, 撫で, しごけ, しごい, 挿れ, 入れて, 触っ, まさぐ, 吸っ",
        "against": "憎む, 恥, 差別, 呼ぶな, 呼ばない, いけない, 許され, 侮辱, 謝, 間違って, 言うべきでは, 言ってはいけ, 言うな",
        "plain": "子犬, 犬, 獣医, 農場, 地下室, 医者, 患者, 検査, 検診, 乳がん, 肉眼, コーヒー, ケーキ, エンジン, 鶏, 雌犬, 猫, 病院",
        "look": "なんて, 見ろ, あの, あいつは",
        "only": "ただの, しょせん",
        "weapon": "ナイフ, 包丁, 銃, 刃物, 斧, 弾",
        "they": "奴ら, あいつら, やつら, 連中, こいつら, 全員, 人は, どもは, 一人残らず",
        "exterm": "皆殺し, 根絶, 絶滅させ, 吊るせ, 吊るし, 駆除, 抹殺, 処刑, 焼き払, 殺し尽く, ガス室, 一掃しろ",
        "are": "人は, どもは, 奴らは, らは, 連中は, 民は",
        "foul": "害虫, 寄生虫, ゴキブリ, ゴミだ, クズだ, 泥棒, 強姦魔, 下等, ばい菌, 獣だ, 畜生, 害獣, 犯罪者, ウジ虫, 疫病, 野蛮",
        "sort": "みたいな, のような, ような奴, 類の",
        "holy": "寺院, 教会, モスク, 神社",
        "fire": "燃や, 火をつけ, 焼け, 放火",
        "low": "台所に, 頭が悪すぎ, 劣って, ひざまず, 従え",
        "pose": "脚を開, 足を開, 四つん這い, 股を開, 脚を広げ",
        "plea": "おねだり, 欲しがれ, もっと奥",
    },
}

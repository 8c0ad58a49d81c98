"""Word classes and clause patterns of the abuse grammar. Everything here is a fixed value, stated as text.

A line of CLASSES is `name weight: words`; a word with `*` at its end matches all words that begin with it,
and `_` joins the words of a phrase. Patterns are sequences of classes (alternatives joined by `|`), where
`..n` allows up to n other words in between, and the number after `=` is the weight of the pattern.
"""

# Word classes in English, Spanish, German, French, Italian and Portuguese, with the commonest words of
# Russian, Dutch, Polish and Korean. Words of scripts without spaces follow further down.
CLASSES = """
you 1: you your yours yourself u ur youre you're du dich dir dein deine deinem deinen deiner deines euch ihr eure tu tú te ti contigo tus eres usted vos os sos toi vous votre ton voi você teu ты тебя тебе твой твоя твоё твои вы вас вам ваш jij jou je jouw ty ciebie twój twoja tuo tua tuoi 너 너는 넌 너를 너희 네가 당신 당신은
youare 1: you're youre u're eres sois estás bist seid t'es
be 1: are is were be was re bist ist seid sind eres es son sois estás está tes êtes sei siete é são zijn bent jesteś jest это
i 1: i i'm im i'll ill we we'll ich wir yo nosotros je somebody someone
will 1: will would gonna going wanna shall swear i'll ill werde werden voy vamos juro schwöre sonst vais otherwise
never 1: never nie niemals nunca jamás nobody no_one niemand nadie keiner jamais
not 1: not isn't aren't wasn't don't nicht kein keine keinen pas didn't
insult 1: idiot* moron* imbecil* imbécil* cretin* halfwit* dimwit* nitwit* bonehead* dumbass* asshole* arsehole* scumbag* bastard* dickhead* shithead* fuckwit* twat* wanker* jackass* dunce* loser* retard* simpleton* numbskull* blockhead* airhead* knucklehead* douchebag* motherfucker* bitch* whore* slut* cunt* prick* arschloch* drecksack* vollidiot* hirntoter* hirntote schwachkopf* dummkopf* trottel* versager* mistkerl* hurensohn* wichser* schlampe* miststück* penner* blödmann* hohlkopf* depp spast* gilipollas cabrón cabrones pendejo* capullo* payaso* inútil* estúpid* imbécil* subnormal* malnacid* zorra* connard* salaud* abruti* enculé* stronzo* cretino* idiota* babaca* otário* coglion* testa_di_cazzo deficient* scem* imbecill* cazzon* puttan* troia connasse pute salope crétin* enfoiré* идиот* дурак* дура дебил* кретин* сука мразь ублюд* тварь придур* ничтожеств* klootzak* eikel* hoer sukkel* mongool kurwa dupek idiot* debil* szmata 바보* 멍청* 병신* 쓰레기야 개새끼*
beastly 0.7: pig pigs worm worms leech* parasite* filth scum garbage trash maggot* rat rats snake* swine vermin cockroach* sack_of_shit piece_of_shit waste_of_space disgrace clown* fool fools reptile* toad* rodent* brute* wurm ratte* schwein* parasit parasiten abschaum müll dreck ungeziefer stück_scheiße gusano* cerdo* cerda* parásito* basura escoria rata ratas sanguijuela* alimaña* asqueros* pedazo_de_mierda pedazo_de_basura vermine ordure verme porco lixo
slur 0.9: vermin subhuman* cockroach* rats rat savages savage animals trash scum parasites disease plague pest filth beasts vermin* maggots pigs dogs apes monkeys criminals ungeziefer gesindel abschaum viehzeug pack ratten parasiten untermenschen schädlinge seuche tiere ratas plaga plagas alimañas bestias cucarachas escoria basura animales parásitos salvajes infrahumanos sabandijas vermine parassiti
mean 0.6: stupid brainless useless worthless pathetic spineless gutless miserable repulsive disgusting rotten braindead dumb filthy lousy dimwitted incompetent hideous ugly clueless fucking bloody nasty vile vicious loathsome widerlich* hirnlos* erbärmlich* dreckig* dumm* nutzlos* hässlich* ekelhaft* armselig* verdammt* repugnante* asqueros* patétic* despreciable* miserable* podrid* mierda estúpid* inútil* ridícul* stupide* minable* stupido* inutile* тупой тупая тупые жалкий мерзкий domme waardeloze głupi głupia żałosn* pathétique* inutile* patetic* schifos*
curse 0.8: fuck fucking fck screw damn_you go_to_hell vete_al_infierno vete_a_la_mierda que_te_jodan jódete chinga* verpiss* fick* leck_mich va_te_faire vaffanculo foda-se piss_off иди_нахуй пошёл_нахуй пошел_нахуй отвали spierdalaj fottiti val_dood krijg_de
gone 0.8: get_lost drop_dead go_drown go_die kill_yourself delete_yourself eat_dirt eat_shit jump_off* jump_off_a choke_on rot_in crawl_back hang_yourself go_hang burn_in_hell die_in shut_up shut_your kys go_to_hell lárgate piérdete muérete púdrete ojalá_te muere cállate verreck* stirb krepier* verschwinde halt_dein* halt_die halt_endlich geh_sterben hau_ab zieh_leine crève_ muori сдохни убирайся заткнись иди_к_чёрту crepa vai_a_morire rot_op zdychaj 꺼져 죽어* 뒤져* jump_in_front_of jump_off jump_under spring_vor spring_von tírate_de end_it_all
wish 1: drown die dead suffer rot bleed vanish disappear existing exist breathe breathing perish mueras muerte sterben stirbst krepierst desaparecieras desaparecer born hang sufras sufrir verrecken leiden verschwinden exister умри мучайся
harm 1: hurt smash kill burn stab break beat strangle murder punch choke shoot slit crush cut gut destroy bury hunt bleed suffer rip find_you find_out_where wait_for_you slap rape umbringen töten schlagen schlage breche brechen abstechen verbrennen verprügeln warte_auf_dich warte erwürge ersteche zünde finde_dich mato matar matarte rompo romper quemo quemar apuñal* espero golpe* reviento parto tuer frapper
body 1: teeth tooth house home family face neck throat bones bone legs fingers finger hand hands head skull kids children wife mother car eyes arm arms blood bleed knees ribs life zähne haus familie gesicht hals knochen beine kopf kinder blut blutig finger hände leben dientes casa familia cara cuello huesos piernas dedos cabeza hijos sangre manos vida
weapon 1: knife gun bat axe rope gasoline petrol hammer bullet blade fists dark_alley car_park parking_lot messer pistole axt hammer cuchillo navaja pistola martillo couteau
follow 1: train route_home street address live lives sleep walk bus school park desk door evening night dónde_vives wo_du_wohnst vives wohnst duermes schläfst
people 1: people person persons developer* contributor* account* user* folk* folks women woman girls men man coder* programmer* member* families workers engineer* maintainer* leute menschen entwickler* frauen männer gente personas personas desarrollador* colaborador* cuentas cuenta mujeres hombres usuarios gens personnes
group 1: immigrant* foreign foreigner* migrant* refugee* female* women elderly old_people gay* lesbian* trans queer* black* white* jew* jewish muslim* christian* arab* asian* african* gypsy gypsies disabled homosexual* ausländer* zuwanderer* flüchtling* migranten frauen juden muslime schwarze behinderte alte extranjer* inmigrante* mujeres negros moros gitanos judíos ancianos viejos homosexuales norteños étrangers arabes juifs immigrés
they 1: they they're these those them their dieses diese die sie son estos esos estas esas
expel 0.8: get_rid_of rid_the kept_out keep_out send_the* sent_back send_them go_back_to back_where kick_out kick_them raus fuera wipe_out wipe_them exterminate deport ban_every ban_all lie_and_steal breed_like in_their_blood no_place_for out_of_our dehors via_da
sexual 0.9: porn* porno* nude nudes naked topless sex sexvideo* sextape* sex_tapes sexy xxx horny boobs tits breasts dick cock pussy cum blowjob orgasm erotic nsfw webcam dirty_webcam nudity hardcore fetish oben_ohne nackt nacktbild* nacktfoto* sexbild* titten schwanz muschi geil fick* brüste desnud* porno pornográfic* tetas polla coño follar pechos sexo culo cachond* seins nue nues tette
lewd 0.7: lick touch feel kiss grope undress strip fondle spank sleep_with have_sex in_bed bend_over sit_on suck lecken anfassen berühren ausziehen küssen begrapschen lamer tocar tocarte besar manosear desnudar desnúdate acostarme chupar
offer 1: click free send hot singles tonight share videos pictures pics shots photos shows tapes watch uncensored adults sign_up schick schicke videos bilder fotos gratis kostenlos mándame envíame manda envía vídeos fotos heute_nacht esta_noche
party 1: she he her his him yourself sie er ihn ihm ella él lei
role 1: maintainer reviewer tester writer translator operator contributor colleague manager boss engineer developer admin team captain desk group
report 1: report reports reported reporting policy policies harassment mention mentions mentioned word words term terms phrase label labels moderation moderators filter* classifier detect* example* quote* rule rules guidelines conduct column field glossary dictionary translation meaning definition forbidden banned_words study survey statistics flagged melden richtlinie* wort política* palabra* término* denuncia* acoso belästigung
thing 1: process processes thread threads pointer pointers node nodes job jobs child parent row rows test tests build table server script command signal task tasks query branch loop daemon container latin demo maze column code cache line lines file files bug bugs connection session data value values
kind 1: kind sort type clase tipo sorte was_für qué_clase what_a lol_what only menudo menuda so_ein such_a vaya
alike 1: like_you just_like_you as_you wie_du genau_wie_du como_tú igual_que_tú y_tú_también comme_toi come_te
demean 0.9: waste_of_air waste_of_oxygen waste_of_skin not_worth_the_air end_your_life better_dead should_not_exist deserve_to_die deserve_to_suffer never_be_loved stopped_existing
lack 1: notice merken bemerken merkt miss missed love loves loved want wants wanted need needs like likes notice care cares respect respects stand trust vermissen vermisst mag mögen will liebt braucht leiden ertragen ausstehen echaría extrañ* quiere quieren aguanta soporta echa aimera aime veut mancherai vuole ama
nobody 1: nobody no_one noone none niemand keiner nadie ninguno personne nessuno никто nikt
better 1: better happier nicer cleaner safer besser glücklicher mejor felices feliz mieux meglio
without 1: without ohne sin sans senza без bez
should 1: should shouldn't deserve deserves deserved ought must verdienst verdient verdienen solltest sollte sollten sollen müssen gehört gehören mereces merece merecen deberías debería deberían deben devrais devrait dovresti
hope 1: hope wish pray hoffe wünsche wünschte espero ojalá deseo j'espère souhaite spero
mishap 1: crash crashes explode explodes collapse collapses burns abstürzt abbrennt explodiert estrelle explote queme drowns sinks
carrier 1: plane car flight train bus boat house flugzeug auto haus avión coche casa avion
brain 1: brain brains braincell* mind gehirn hirn verstand cerebro iq skull cerveau cervello
little 1: small smaller tiny empty missing half pea shrunken rotten hollow absent none kleiner klein winzig* leer* fehlt hohl pequeño vacío nada minúsculo vide petit
marvel 1: miracle wonder wonders surprised surprising amazed astonishing astonished impressed wunder erstaunlich milagro sorprende increíble miracolo
kin 1: mother mom mum mama father parents mutter vater eltern madre padre padres mère parents
likeyou 1: people_like_you someone_like_you anyone_like_you somebody_like_you person_like_you leute_wie_du jemand_wie_du menschen_wie_du gente_como_tú alguien_como_tú gens_comme_toi
problem 1: reason problem trouble shame disgrace grund problem schande razón motivo problema vergüenza why raison
near 1: near close around touch nahe nähe cerca
let 1: let lets allow allowed permit lassen lässt dejar dejen deja permitir
folk 1: immigrant immigrants migrant migrants refugee refugees foreigners jew jews muslim muslims arabs africans gypsies gays lesbians homosexuals blacks asians women females ausländer zuwanderer flüchtlinge migranten juden muslime zigeuner schwule frauen inmigrantes extranjeros judíos moros gitanos musulmanes maricones mujeres immigrés arabes juifs musulmans immigrati ebrei stranieri
remove 1: removed deported expelled exterminated eliminated gassed purged erased shot hanged banned abgeschoben vernichtet vergast ausgerottet entfernt deportar deportados eliminar eliminados exterminar expulsados fusilar expulsés
control 1: control controls run own rule steal lie invade infest kontrollieren beherrschen stehlen lügen controlan roban mienten invaden
back 1: go_back go_home geh_zurück geht_zurück vuelve_a vuélvete volved_a regresa_a retourne torna_a piss_off_to
country 1: country homeland land heimat país países tierra pays paese desert desierto jungle village
viewed 1: treated called regarded seen portrayed considered described depicted labelled likened compared behandelt bezeichnet genannt dargestellt tratados tratadas llamados considerados descritos traités appelés
explicit 0.9: masturbat* masturb* ejaculat* blowjob* handjob* orgasm* onanier* wichste wichsen eyacul* corrió_dentro undressed moaned groped fingered
live 1: wake wakes awake recover return come live breathe aufwachst aufwachen aufwacht wiederkommst despiertes despertar vuelvas regreses réveilles
feature 1: face voice accent body looks gesicht stimme aussehen cara voz acento visage
with 1: with mit con avec
bid 1: favour favor please kindly gefallen bitte just_go favor hazme why_don't_you
selfharm 0.9: kill_yourself hang_yourself end_your_life kys bring_dich_um häng_dich_auf mátate suicídate tue-toi 自杀吧
speech 1: says said say wrote writes reads states stated quoted quotes quoting replied shouted claims claimed sagt sagte schreibt schrieb lautet zitiert dice dijo escribió decía reza cita dit écrit disse scrisse
if 1: if wenn falls si se если jeśli
warn 1: you_will_see you'll_see you_will_regret you'll_regret ya_verás du_wirst_sehen wirst_es_bereuen te_vas_a_arrepentir te_arrepentirás tu_vas_voir
"""

# Patterns. A doubled class must be met twice.
PATTERNS = """
address: you ..2 be ..4 insult|beastly = 1
address-one: youare ..3 insult|beastly = 0.95
gone-alone: gone ..6 gone = 0.9
address-mean: you ..1 be ..2 mean ..3 insult|beastly = 1
vocative: you ..2 mean ..2 insult|beastly = 1
vocative-bare: you insult = 0.9
vocative-end: insult ..6 you = 0.75
vocative-beast: mean ..1 beastly ..6 you = 0.8
exclaim: kind ..3 insult = 0.85
exclaim-beast: kind ..3 beastly = 0.75
exclaim-mean: kind ..2 mean ..2 insult|beastly = 0.95
judged: role ..2 be ..2 mean|insult ..2 insult|beastly = 1
judged-bare: role ..1 be ..2 insult|beastly = 0.9
whoever: be ..2 mean ..2 insult = 0.85
pair: insult|mean ..2 insult ..4 gone = 1
mean-insult: mean insult = 0.9
is-insult: be ..1 insult = 0.75
compare: mean|insult|beastly ..8 alike = 1
curse-you: curse ..2 you|insult|beastly = 1
curse-insult: curse ..6 insult|beastly = 0.9
away: gone ..4 insult|beastly|you = 0.95
away-after: insult|beastly|you|mean ..8 gone = 0.9
away-bare: kind ..6 gone = 0.9
scorn: demean = 0.75
scorn-twice: demean ..8 demean = 1
wish: you ..5 wish = 0.5
nobody: nobody ..3 lack ..2 you = 0.85
nobody-you: nobody ..2 you ..2 lack = 0.85
without: better ..4 without ..1 you|folk = 0.85
without-first: without ..1 you ..6 better = 0.85
death: i ..2 wish ..3 you ..3 wish = 0.9
hope: hope ..2 you ..3 wish = 0.9
hope-never: hope ..1 you ..1 never ..3 wish|lack|live = 0.85
feature: with ..1 you ..1 feature ..3 should ..2 not|never = 0.8
mean-you: mean ..3 you beastly = 0.85
bid: bid ..6 gone = 0.85
selfharm: selfharm = 0.85
if-weapon: if ..3 you ..12 harm ..8 weapon|body = 0.95
hope-mishap: hope ..2 you ..1 carrier ..2 mishap = 0.85
deserve: you ..2 should ..4 wish = 0.85
brain: you ..4 brain ..4 little|mean = 0.85
brain-less: mean|little ..2 brain ..8 you = 0.7
brain-size: brain ..2 little = 0.7
without-brain: without ..2 brain = 0.7
marvel: marvel ..3 you ..6 wish = 0.85
kin: you ..1 kin ..2 should|never ..10 wish|lack = 0.85
likeyou: likeyou ..6 wish|problem|insult|mean|beastly|slur = 0.85
likeyou-should: likeyou ..2 should ..2 never|not|wish = 0.75
never-near: never ..2 let ..2 you|likeyou|people|group ..4 near = 0.75
threat: i ..1 will ..5 harm ..1 you ..4 body = 1
threat-you: i ..1 will ..5 harm ..2 you = 0.8
threat-body: will ..6 harm ..3 body = 0.85
threat-make: will ..5 you ..2 wish|body = 0.75
threat-weapon: i|will ..10 you ..10 weapon = 0.95
weapon-you: weapon ..5 you = 0.6
threat-if: if ..2 you ..10 harm ..4 you|body = 0.95
threat-warn: harm ..10 warn = 0.8
threat-own: harm ..3 you ..1 body = 0.7
stalk: i ..3 follow ..2 you ..14 harm|weapon|will = 0.9
stalk-where: i ..3 follow ..1 you ..1 follow = 0.75
hate: people|group|they ..4 be ..4 slur = 1
hate-near: people|group ..10 slur = 0.7
hate-they: they ..3 slur = 0.75
hate-expel: people|group ..10 expel ..8 slur = 1
hate-expel-before: expel ..6 people|group ..10 slur = 1
expel-slur: expel ..8 slur = 0.95
slur-expel: slur ..8 expel = 0.95
expel-twice: expel ..10 expel = 0.9
expel-group: group ..4 expel = 0.85
group-expel: expel ..4 group = 0.85
raus: expel they = 0.5
folk-remove: folk ..8 should ..2 remove = 0.95
folk-control: folk ..2 control ..8 should|expel|slur = 0.9
back: back ..4 country = 0.85
explicit: party|you|i ..4 explicit = 0.85
explicit-body: explicit ..4 party|you = 0.7
porn-offer: offer ..3 sexual = 0.95
offer-porn: sexual ..4 offer = 0.8
lewd-you: lewd ..3 you ..6 sexual|lewd = 1
lewd-body: lewd ..3 you ..4 = 0.6
lewd-want: i ..10 lewd ..3 you = 0.9
sexual-you: sexual ..3 you = 0.85
you-sexual: you ..3 sexual = 0.8
favour: party ..8 party ..10 lewd|sexual = 0.9
"""

# Words of Japanese and Chinese, found anywhere in a clause, the longest first. The classes are those of
# the patterns below and `report`, `thing` and `not` above.
CJK_CLASSES = """
who 1: お前 おまえ オマエ あなた 貴様 きさま てめえ テメエ てめぇ あんた きみ 君は 君の 君を こいつ そいつ あいつ 你 你们 您 妳 他就是 她就是
they 1: 奴ら やつら 連中 人は 人間は 外国人 移民 難民 女は 女ども 老人 障害者 黒人 韓国人 中国人 黑人 移民 女人 犹太人 穆斯林 他们
abuse 0.85: 馬鹿 バカ ばか アホ あほ 間抜け まぬけ クズ くず 屑 ゴミ ごみ カス 無能 役立たず 能無し 脳なし 寄生虫 害虫 ゴキブリ 虫けら ウジ虫 豚 ブタ ブス キモい 気持ち悪 最低 低能 負け犬 獣 けだもの 畜生 ネズミ ねずみ 疫病 白痴 笨蛋 蠢货 傻逼 傻瓜 废物 混蛋 贱人 畜牲 杂种 猪狗 人渣 害虫 蟑螂
away 0.9: 死ね 氏ね くたばれ 消え失せろ 消えろ 失せろ 出て行け 出ていけ 地獄に落ち 去死 滚开 滚蛋 滚出 生きる価値 二度と目を覚ま いなくなれば 野郎 売女 操你
violence 0.9: 殺してやる ぶっ殺 殴ってやる 殴り殺 ぶん殴 刺してやる 燃やしてやる 首を絞め 家に火 家族を傷つ ナイフを持って 杀了你 弄死你 打死你 宰了你
obscene 0.9: エロ動画 エロ画像 無修正 アダルト動画 ポルノ ヌード写真 裸の写真 おっぱい 胸を触 体を触 脱げ ヤらせろ セックスし 色情 裸照 性爱视频 摸你
report 1: 報告 方針 単語 用語 禁止 報告書 通報 と書いた と言った と述べ という言葉 という語 举报 报告 政策 词语 写道 禁止
thing 1: プロセス スレッド コマンド ポインタ 箱 进程 线程 回收
not 1: ではない じゃない ではありません 不是 没有 别说
"""

# Patterns over those; gaps are counted in letters.
CJK_PATTERNS = """
ja-address: who|they ..12 abuse = 1
ja-address-end: abuse ..6 who = 0.8
ja-away: away = 1
ja-violence: violence = 1
ja-obscene: obscene = 1
ja-hate: they ..20 abuse|away = 0.9
"""

# Letters that look like Latin ones, and digits and signs that stand for letters.
CONFUSABLE = dict(zip("аеорсухіјѕԁһкмтвнгԛԝзпАЕОРСУХІЈЅКМТВНαορνικτυεхΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhkmtbhrqw3nAEOPCYXIJSKMTBHaopvikTuexABEZHIKMNOPTYX"))
LEET = dict(zip("013457$@!|+€", "oieastsailte"))

"""Word lists and lookup tables used by the text rules."""

# Informal pronouns and negations -> standard form, applied after the ASCII clean.
PRONOUN_MAP = {
    "gue": "saya", "gua": "saya", "aku": "saya", "saya": "saya",
    "kamu": "anda", "elo": "anda", "lu": "anda",
    "gak": "tidak", "nggak": "tidak", "enggak": "tidak", "ga": "tidak",
    "bgt": "sangat", "banget": "sangat", "marah": "marah", "benci": "benci",
}

# Slang and abbreviations -> standard form, applied after the Unicode clean.
SLANG_MAP = {
    "gak": "tidak", "ga": "tidak", "gk": "tidak", "nggak": "tidak", "ngga": "tidak",
    "kaga": "tidak", "kagak": "tidak", "tdk": "tidak", "yg": "yang", "dgn": "dengan",
    "bgt": "banget", "aja": "saja", "sy": "saya", "gw": "saya", "gue": "saya", "gua": "saya",
    "lu": "kamu", "lo": "kamu", "elo": "kamu", "km": "kamu", "kmu": "kamu", "elu": "kamu",
    "w": "saya", "krn": "karena", "krna": "karena", "karna": "karena", "utk": "untuk",
    "buat": "untuk", "jd": "jadi", "jgn": "jangan", "jgnkan": "jangankan", "gmn": "bagaimana",
    "gimana": "bagaimana", "knp": "kenapa", "kenapa": "mengapa", "dmn": "dimana",
    "drmn": "dari mana", "kpn": "kapan", "brp": "berapa", "brapa": "berapa", "sm": "sama",
    "sma": "sama", "skrg": "sekarang", "skrng": "sekarang", "td": "tadi", "bsk": "besok",
    "kmrn": "kemarin", "kmaren": "kemarin", "tar": "nanti", "ntar": "nanti", "nti": "nanti",
    "udh": "sudah", "udah": "sudah", "dah": "sudah", "blm": "belum", "blum": "belum",
    "bkn": "bukan", "bnr": "benar", "bener": "benar", "emg": "memang", "emang": "memang",
    "tau": "tahu", "gatau": "tidak tahu", "gtau": "tidak tahu", "pgn": "ingin",
    "pengen": "ingin", "pngen": "ingin", "mau": "ingin", "bs": "bisa", "bsa": "bisa",
    "hrs": "harus", "harusnya": "seharusnya", "bngt": "banget", "bener2": "benar-benar",
    "cape": "capai", "capek": "lelah", "cakep": "cantik/tampan", "kece": "keren",
    "mantul": "mantap betul", "mantep": "mantap", "gokil": "gila", "parah": "sangat",
    "anjay": "ekspresi kaget/kagum", "santuy": "santai", "woles": "santai",
    "baper": "bawa perasaan", "kepo": "ingin tahu urusan orang", "julid": "iri/sirik",
    "ambyar": "hancur/berantakan", "receh": "lucu remeh",
    "otw": "on the way / dalam perjalanan", "gpp": "tidak apa-apa", "gapapa": "tidak apa-apa",
    "cmiiw": "correct me if I'm wrong", "btw": "ngomong-ngomong", "fyi": "sebagai informasi",
    "pls": "tolong", "thx": "terima kasih", "makasih": "terima kasih", "gaje": "tidak jelas",
    "japri": "jalur pribadi (chat pribadi)", "japrii": "jalur pribadi", "wkwk": "tertawa",
    "wkwkwk": "tertawa", "haha": "tertawa", "anjir": "ekspresi kaget", "yaudah": "ya sudah",
    "udahlah": "sudahlah", "kayanya": "kayaknya", "kayaknya": "sepertinya", "kyk": "seperti",
    "kek": "seperti", "sbnrnya": "sebenarnya", "sebenarnya": "pada dasarnya", "org": "orang",
    "org2": "orang-orang", "tp": "tapi", "tpi": "tapi", "dr": "dari", "trs": "terus",
    "trus": "terus", "abis": "habis", "abisin": "habiskan", "duit": "uang",
    "cuan": "keuntungan/uang",
}

# Terms counted by the toxicity meter, its severe subset and its constants.
METER_TERMS = (
    "benci", "marah", "menghina", "sakit", "hancurkan", "serang", "bunuh", "mencela",
    "menyerang", "ancam", "bajingan", "brengsek", "kontol", "jawir",
)
METER_SEVERE_TERMS = ("hancurkan", "serang", "bunuh", "ancam")
METER_SEVERE_BONUS = 0.25
METER_TOXIC_FROM = 0.2

# Keyword groups of the compact mood feature vector, in vector order.
KEYWORD_GROUPS = {
    "happy": ("happy", "bahagia", "senang", "suka"),
    "angry": ("angry", "marah", "benci", "menghina"),
    "sad": ("sedih", "duka", "kecewa"),
    "neutral": ("baik", "ramah", "tenang", "damai"),
}

# Prefix terms of the gambling-promotion pattern.
GAMBLING_TERMS = ("menang", "suka", "juara", "singapore", "sidney", "sydney")

# Hashtags and language of the public-post feed.
FEED_HASHTAGS = (
    "indonesia", "sppg", "mbg", "viral", "pemerintah", "uu", "dpr", "jawa", "korupsi", "judi",
)
FEED_LANG = "id"

# Annotated 0/1 category columns of the comment table.
CATEGORY_COLUMNS = (
    "profanity_obscenity", "threat_incitement_to_violence", "insults", "identity_attack",
    "sexually_explicit",
)

# Profanity lexicon as (expression, region); repeated expressions add regions.
PROFANITY = (
    ("anjing", "Indonesia"), ("anjir", "Indonesia"), ("bangsat", "Indonesia"),
    ("bajingan", "Indonesia"), ("brengsek", "Indonesia"), ("kampret", "Indonesia"),
    ("keparat", "Indonesia"), ("bedebah", "Indonesia"), ("bangke", "Indonesia"),
    ("sialan", "Indonesia"), ("bajigur", "Indonesia"), ("goblok", "Indonesia"),
    ("goblog", "Indonesia"), ("tolol", "Indonesia"), ("bodoh", "Indonesia"),
    ("bego", "Indonesia"), ("dungu", "Indonesia"), ("idiot", "Indonesia"),
    ("brengsek", "Indonesia"), ("kontol", "Indonesia"), ("memek", "Indonesia"),
    ("ngentot", "Indonesia"), ("jembut", "Indonesia"), ("kampungan", "Indonesia"),
    ("tai", "Indonesia"), ("taik", "Indonesia"), ("kimak", "Sumatera Utara"),
    ("pukimak", "Melayu"), ("jancuk", "Jawa Timur"), ("jancok", "Jawa Timur"),
    ("ancuk", "Jawa Timur"), ("cuk", "Jawa Timur"), ("diancuk", "Jawa Timur"), ("asu", "Jawa"),
    ("kirik", "Jawa"), ("bajul", "Jawa"), ("ndasmu", "Jawa"), ("matamu", "Jawa"),
    ("raimu", "Jawa"), ("goblog", "Jawa"), ("koplak", "Jawa"), ("ndlogok", "Jawa Timur"),
    ("mbadut", "Jawa Timur"), ("congor", "Jawa"), ("cangkem", "Jawa"),
    ("jangkrik", "Jawa Timur"), ("ndas", "Jawa"), ("suwek", "Jawa"), ("pekok", "Jawa"),
    ("sinting", "Indonesia"), ("gila", "Indonesia"), ("edan", "Jawa"), ("sarap", "Indonesia"),
    ("sontoloyo", "Jawa"), ("siah", "Sunda"), ("kehed", "Sunda"), ("anying", "Sunda"),
    ("anjing", "Sunda"), ("goblok", "Sunda"), ("bebel", "Sunda"), ("belegug", "Sunda"),
    ("kiruh", "Sunda"), ("bagong", "Sunda"), ("monyet", "Indonesia"), ("beruk", "Indonesia"),
    ("kadal", "Indonesia"), ("ular", "Indonesia"), ("buaya", "Indonesia"),
    ("bencong", "Indonesia"), ("banci", "Indonesia"), ("bajingan", "Indonesia"),
    ("lonte", "Indonesia"), ("pelacur", "Indonesia"), ("jalang", "Indonesia"),
    ("brengsek", "Indonesia"), ("kampungan", "Indonesia"), ("norak", "Indonesia"),
    ("alay", "Indonesia"), ("lebay", "Indonesia"), ("bacot", "Jakarta"), ("bacod", "Jakarta"),
    ("cerewet", "Indonesia"), ("berisik", "Indonesia"), ("berengsek", "Indonesia"),
    ("bawel", "Indonesia"), ("rese", "Jakarta"), ("nyebelin", "Jakarta"),
    ("nyolot", "Jakarta"), ("songong", "Indonesia"), ("sombong", "Indonesia"),
    ("belagu", "Indonesia"), ("sokap", "Indonesia"), ("sok tahu", "Indonesia"),
    ("muka tembok", "Indonesia"), ("muka badak", "Indonesia"), ("otak udang", "Indonesia"),
    ("otak kosong", "Indonesia"), ("otak dengkul", "Indonesia"), ("dasar bodoh", "Indonesia"),
    ("dasar tolol", "Indonesia"), ("dasar goblok", "Indonesia"), ("kurang ajar", "Indonesia"),
    ("tidak tahu diri", "Indonesia"), ("tak tahu malu", "Indonesia"),
    ("muka dua", "Indonesia"), ("penjilat", "Indonesia"), ("pengkhianat", "Indonesia"),
    ("sampah", "Indonesia"), ("sampah masyarakat", "Indonesia"),
    ("tidak berguna", "Indonesia"), ("benalu", "Indonesia"), ("parasit", "Indonesia"),
    ("pecundang", "Indonesia"), ("pengecut", "Indonesia"), ("payah", "Indonesia"),
    ("memalukan", "Indonesia"), ("menjijikkan", "Indonesia"), ("menyebalkan", "Indonesia"),
    ("kampungan banget", "Indonesia"), ("brengsek banget", "Indonesia"),
    ("tai kucing", "Indonesia"), ("tai anjing", "Indonesia"), ("anak haram", "Indonesia"),
    ("bajingan tengik", "Indonesia"), ("dasar keparat", "Indonesia"), ("perusak", "Indonesia"),
    ("penipu", "Indonesia"), ("pembohong", "Indonesia"), ("munafik", "Indonesia"),
    ("kafir", "Indonesia"), ("sesat", "Indonesia"), ("biadab", "Indonesia"),
    ("tidak beradab", "Indonesia"), ("durjana", "Indonesia"), ("laknat", "Indonesia"),
    ("terkutuk", "Indonesia"), ("iblis", "Indonesia"), ("setan", "Indonesia"),
    ("siluman", "Indonesia"), ("brengsek", "Indonesia"), ("sial", "Indonesia"),
    ("celaka", "Indonesia"), ("kampret lu", "Jakarta"), ("bacot lu", "Jakarta"),
    ("sok jago", "Indonesia"), ("sok suci", "Indonesia"), ("sok pintar", "Indonesia"),
    ("sok hebat", "Indonesia"), ("miskin akhlak", "Indonesia"), ("tipis otak", "Indonesia"),
    ("otak miring", "Indonesia"), ("otak mesum", "Indonesia"), ("mulut sampah", "Indonesia"),
    ("manusia sampah", "Indonesia"), ("dasar pemalas", "Indonesia"), ("pemalas", "Indonesia"),
    ("benalu hidup", "Indonesia"), ("tidak punya otak", "Indonesia"),
    ("tidak punya malu", "Indonesia"), ("tidak punya moral", "Indonesia"),
    ("tidak punya harga diri", "Indonesia"), ("tidak punya akhlak", "Indonesia"),
    ("tidak punya hati", "Indonesia"), ("tidak punya perasaan", "Indonesia"),
    ("dasar munafik", "Indonesia"), ("dasar penipu", "Indonesia"),
    ("dasar pengecut", "Indonesia"), ("dasar pengkhianat", "Indonesia"),
    ("dasar penjilat", "Indonesia"), ("dasar parasit", "Indonesia"),
    ("dasar sampah", "Indonesia"), ("dasar benalu", "Indonesia"),
    ("dasar bajingan", "Indonesia"), ("dasar bangsat", "Indonesia"),
    ("dasar brengsek", "Indonesia"),
)

"""Word lists, rule tables and thresholds.

These are fixed values: results depend on them as they stand and in this order.
"""

from __future__ import annotations

# Language identification -------------------------------------------------

TAMIL = "[\\u0B80-\\u0BFF]"
#: White space as the SQL of the queries has it, without the vertical tab.
TOKEN_BREAK = "[\\t\\n\\f\\r\\p{Z}\\u0964\\u0965.,!?;:\"'()\\[\\]{}<>]+"

TANGLISH_WORDS = (
    "naan nee avan aval nanga unga inga avanga avangaluku enakku unakku avanukkku avanukku "
    "sollu paaru vaa po ponga vandhaan vandha vandhen vandhutu irukku illai irukkaan irukken irukka "
    "pannunga pannu pandu solla paakka vaanga solren paakren kekkaren "
    "romba konjam nalla kettavanu periya chinna azhaga nannaa bayangara appadiye ippadiye "
    "seri da di la le nu nga macha machan dei thambi anna akka amma appa "
    "enna yenna epdi eppadi eppo yeppo enga yenga yaaru yaen yean ethu "
    "veetu padam ooru naadu kadai school college kaasu paiyan ponna pasanga payyan "
    "thaan ellam mattum kuda irundha aana aanaa appo ippo vera veru "
    "vittaa vidu vittaen theriyum theriyathu puriyuthu puriyala sollitten ketten "
    "super mass boss guru"
).split()

TANGLISH_AFFIXES = (
    "kku ukku la le liye nga anga inga ren reen ran raan tten dhen chen kitten ndhen ndhan "
    "na naa tha thaa ndhaa matteen matten nu nnu vutten tutten duten"
).split()

LANGUAGE_THRESHOLDS = {
    "tamil_dominant": 0.70,
    "code_mix_min": 0.20,
    "tanglish_min": 0.35,
    "english_dominant": 0.70,
    "vocab_weight": 1.0,
    "affix_weight": 2.0,
    "script_weight": 0.7,
    "heuristic_weight": 0.3,
}

# Normalisation -----------------------------------------------------------

PHRASES = [
    (r"\bremind\s+pannunga\b", "remind me"),
    (r"\bremind\s+pannu\b", "remind me"),
    (r"\bnyabagam\s+padutthu\b", "remind me"),
    (r"\bcall\s+pottu\s+kudu\b", "call"),
    (r"\bphone\s+pottu\s+kudu\b", "call"),
    (r"\bcall\s+pannu\b", "call"),
    (r"\bphone\s+pannu\b", "call"),
    (r"\bmessage\s+anuppu\b", "send message to"),
    (r"\bmessage\s+podu\b", "send message to"),
    (r"\balarm\s+vai(?:kka|kku)?\b", "set alarm"),
    (r"\balarm\s+set\s+pannu\b", "set alarm"),
    (r"\bvazhi\s+kaatu\b", "directions to"),
    (r"\broute\s+sollu\b", "route to"),
    (r"\bkammi\s+pannu\b", "reduce"),
    (r"\bkuraikka?\b", "reduce"),
    (r"\bkoothu\b", "increase"),
    (r"\bethu?tthu\b", "increase"),
    (r"\boff\s+pannu\b", "turn off"),
    (r"\bon\s+pannu\b", "turn on"),
    (r"\bon\s+panni\b", "turn on"),
    (r"\bsearch\s+pannu\b", "search"),
    (r"\bopen\s+pannu\b", "open"),
    (r"\beppadi\s+iruku\b", "how is"),
    (r"\beppadi\s+iruka\b", "how are you"),
    (r"\bkaalaila\b", "in the morning"),
    (r"\bmaniku\b", "o'clock"),
    (r"\bgym\s+poga\b", "go to the gym"),
    (r"\bsubmit\s+panna\b", "submit"),
    (r"\bsaapida\b", "take"),
    (r"\bmazhai\s+varuma\b", "will it rain"),
    (r"\benna\s+panra\b", "what are you doing"),
    (r"\byenna\s+panra\b", "what are you doing"),
    (r"\blate\s+(?:ah|a)\s+varen\b", "I will come late"),
    (r"\beppadi\s+irukka\b", "how are you"),
    (r"\beppadi\s+irukeenga\b", "how are you"),
    (r"\bpanna\s+mateen\b", "will not do"),
    (r"\bpanna\s+matten\b", "will not do"),
    (r"\bpoga\s+mateen\b", "will not go"),
    (r"\bpoga\s+matten\b", "will not go"),
]

GLOSSES = {
    **dict.fromkeys([
    "dei", "da", "la", "pa", "ppa", "machi", "bruh", "ayya", "thala", "nu", "anna", "ku", "kku", "vendum", "yov", "ille", "vaada", "scene", "ah",
    "inga", "anga", "nga",
], ""),
    "oru": "a", "onnu": "a", "ondru": "a", "konjam": "a little", "romba": "very", "bayangara": "very",
    "sikkiram": "quickly", "semma": "great", "nalla": "good",
    "naalaikku": "tomorrow", "nalaiku": "tomorrow", "naalaiku": "tomorrow", "inniku": "today", "innaiku": "today",
    "ipo": "now", "ippo": "now", "raathiri": "tonight", "kaalaila": "in the morning",
    "amma": "mother", "appa": "father", "thambi": "my brother", "akka": "my sister",
    "paatu": "song", "padal": "song", "podu": "play", "vanakkam": "hello", "sollu": "tell me", "sollunga": "tell me",
    "evlo": "how much", "enna": "what", "naan": "I", "ava": "AVA", "please": "please", "aama": "yes",
    "illai": "no", "illya": "no", "illa": "no", "seri": "okay", "okay": "okay", "paarunga": "check", "paaru": "check",
    "theriyum": "I know", "theriyathu": "I don't know", "puriyuthu": "I understand", "puriyala": "I don't understand",
    "pogiren": "going", "pokiren": "going", "varen": "coming", "vandhen": "came", "vandhaan": "he came", "vandha": "came",
}

DIALECTS = ["Chennai", "Madurai", "Kongu", "Nellai", "Standard"]

DIALECT_RULES = {
    "Chennai": [
        (r"\b(?:vaada|vada)\b", "", "male address marker"),
        (r"\b(?:machi|machan)\b", "", "peer address marker"),
        (r"\b(?:dei|da)\b", "", "informal address"),
        (r"\b(?:bruh|bro)\b", "", "slang address"),
        (r"\bscene\s+theriyuma\b", "do you know", "scene inquiry"),
        (r"\bscene\b", "", "scene filler"),
        (r"\bsemma\b", "great", "intensifier"),
    ],
    "Madurai": [
        (r"\baama\b", "yes", "affirmative"),
        (r"\bennanga\b", "what", "polite inquiry"),
        (r"\bthambi\b(?=\s+ku|\s+kku|\s+\w)", "brother", "address as noun"),
        (r"\bthambi\b", "", "address filler"),
        (r"\bnga\b", "", "politeness marker"),
    ],
    "Kongu": [
        (r"\bla\b(?=\s*[?!.]|$)", "", "sentence-final particle"),
        (r"\bayya\b", "", "respectful address"),
        (r"\byov\b", "", "address marker"),
        (r"\birukku\b", "is", "copula"),
        (r"\birukkaa\b", "is there", "existence query"),
    ],
    "Nellai": [
        (r"\bppa\b", "", "sentence-final particle"),
        (r"\bpa\b(?=\s*[?!.]|$)", "", "sentence-final particle"),
        (r"\bpa\b", "", "address particle"),
        (r"\bille\b(?=\s*[?!.]|$)", "no", "negation/question"),
        (r"\bille\b", "no", "negation"),
    ],
    "Standard": [],
}

#: Markers of the first-match detector, and of the scoring detector.
FIRST_MARKERS = {
    "Chennai": ["dei", "machi", "da", "bruh", "vaada"],
    "Madurai": ["thambi", "aama", "ennanga"],
    "Kongu": ["ayya", "yov", "la", "coimbatore"],
    "Nellai": ["pa", "ppa", "phone pottu kudu"],
}
SCORE_MARKERS = FIRST_MARKERS | {"Nellai": ["pa", "ppa", "ille", "phone pottu kudu"]}

# Anchors -----------------------------------------------------------------

ANCHOR_BREAK = "[\\s.,!?;:\"'()]+"
TIME_WORDS = [
    "tomorrow", "today", "tonight", "now", "morning", "evening", "night", "afternoon", "midnight", "naalaikku", "nalaiku", "inniku", "innaiku", "ipo",
    "ippo", "raathiri", "kaalaila",
]
TIME_ENGLISH = {
    "naalaikku": "tomorrow", "nalaiku": "tomorrow", "naalaiku": "tomorrow", "inniku": "today", "innaiku": "today",
    "ipo": "now", "ippo": "now", "raathiri": "tonight", "kaalaila": "in the morning",
}
NEGATIONS = [
    "illai", "illya", "illa", "matteen", "matten", "no", "not", "never", "don't", "dont", "won't", "wont", "cannot", "can't", "didn't", "mateen",
]
APPS = [
    "whatsapp", "camera", "youtube", "instagram", "gallery", "spotify", "maps", "gmail", "telegram", "netflix",
]
PLACES = [
    "chennai", "coimbatore", "bangalore", "madurai", "office", "home", "college", "school", "hospital", "airport", "tirunelveli", "salem", "erode",
]
DEVICES = ["volume", "brightness", "wifi", "bluetooth", "torch", "flashlight", "hotspot", "data"]
PEOPLE = {
    "amma": "mother", "appa": "father", "thambi": "brother", "akka": "sister", "anna": "brother", "friend": "friend",
    "sister": "sister", "brother": "brother", "wife": "wife", "husband": "husband", "mother": "mother", "father": "father",
}
TAMIL_NUMBERS = {
    "onnu": "1", "rendu": "2", "moonu": "3", "naalu": "4", "anju": "5", "aaru": "6", "ezhu": "7", "ettu": "8",
    "ombodu": "9", "pathu": "10", "pathinardu": "14", "irupathu": "20", "muppadu": "30",
}
TASKS = ["assignment", "medicine", "meeting", "bill", "electricity"]
CLOCK = r"(?i)\b\d{1,2}:\d{2}(?:\s*(?:am|pm))?\b|\b\d{1,2}\s*(?:am|pm)\b"

# Intents -----------------------------------------------------------------

#: The label of a text without any intent.
NO_INTENT = "UNKNOWN_INTENT"
INTENTS = {
    "CREATE_REMINDER": ([r"\bremind\b", r"\balarm\b", r"\btimer\b"], ["task", "date", "time"]),
    "MAKE_CALL": ([r"\bcall\b", r"\bphone\b", r"\bdial\b"], ["person"]),
    "SEND_MESSAGE": ([r"\bsend message\b", r"\bmessage\s+\w+\b", r"\btext\b"], ["person", "message_content"]),
    "CHECK_MESSAGES": ([r"\bcheck\s+message", r"\bread\s+message"], ["app", "person"]),
    "CHECK_EMAIL": ([r"\bcheck\s+email", r"\bread\s+email", r"\binbox\b"], []),
    "SUMMARIZE_MESSAGES": ([r"\bsummarize\b", r"\bsummary\b"], ["app", "person"]),
    "CHECK_CALENDAR": ([r"\bcalendar\b", r"\bschedule\b(?!\s+meeting)", r"\bagenda\b"], ["date"]),
    "CREATE_CALENDAR_EVENT": ([r"\bcreate\s+event\b", r"\bschedule\s+meeting\b", r"\badd\s+to\s+calendar\b"], ["task", "date", "time"]),
    "SEARCH_FILE": ([r"\bsearch\s+file\b", r"\bfind\s+file\b", r"\bdocument\b"], ["query"]),
    "OPEN_APP": ([r"\bopen\b", r"\blaunch\b"], ["app"]),
    "DEVICE_SETTING": ([r"\bvolume\b", r"\bbrightness\b", r"\bwifi\b", r"\bbluetooth\b", r"\bturn\s+(?:on|off)\b"], ["device_setting", "action", "value"]),
    "GENERAL_QUERY": (
        [r"\bsearch\b(?!\s+file)", r"\bhow\s+(?:is|much)\b", r"\bweather\b", r"\bdirections\b", r"\broute\b", r"\bpopulation\b", r"\btraffic\b"],
        ["query"],
    ),
}

CANONICAL_INTENTS = {
    "set_reminder": "CREATE_REMINDER", "create_reminder": "CREATE_REMINDER", "remind": "CREATE_REMINDER", "set_alarm": "CREATE_REMINDER",
    "make_call": "MAKE_CALL", "call": "MAKE_CALL", "send_message": "SEND_MESSAGE", "message": "SEND_MESSAGE",
    "open_app": "OPEN_APP", "launch_app": "OPEN_APP", "device_control": "DEVICE_SETTING", "device_setting": "DEVICE_SETTING",
    "check_weather": "GENERAL_QUERY", "navigate": "GENERAL_QUERY", "play_music": "GENERAL_QUERY", "search_info": "GENERAL_QUERY",
    "smalltalk": "GENERAL_QUERY", "general_query": "GENERAL_QUERY",
}

# Corpus ------------------------------------------------------------------

LABEL_MAPS = {
    "scenario": {0: "Extempore", 1: "Read"},
    "gender": {0: "Female", 1: "Male"},
    "age_group": {0: "18-30", 1: "30-45", 2: "45-60", 3: "60+"},
    "job_type": {0: "Blue Collar", 1: "Student", 2: "Unemployed", 3: "White Collar"},
    "qualification": {0: "No Schooling", 1: "Post Grad + PhD", 2: "Undergrad and Grad.", 3: "Upto 12th"},
    "area": {0: "Rural", 1: "Urban"},
    "lang": {0: "ta"},
    "state": {0: "Tamil Nadu"},
}

DISTRICTS = {
    "Chennai": ["Chennai", "Tiruvallur", "Kanchipuram", "Chengalpattu", "Ranipet", "Vellore"],
    "Madurai": ["Madurai", "Virudhunagar", "Sivaganga", "Theni", "Dindigul", "Ramanathapuram"],
    "Kongu": ["Coimbatore", "Erode", "Tiruppur", "Salem", "Namakkal", "Dharmapuri", "Krishnagiri"],
    "Nellai": ["Tirunelveli", "Thoothukudi", "Tenkasi", "Kanyakumari"],
    "Standard": [
    "Thanjavur", "Tiruchirappalli", "Pudukkottai", "Nagapattinam", "Tiruvarur", "Cuddalore", "Villupuram", "Kallakurichi", "Perambalur", "Ariyalur",
    "Karur", "Tirupattur", "Nilgiris",
],
}
DISTRICT_LIST = [d for ds in DISTRICTS.values() for d in ds]

SENSITIVE = {
    "credential": r"(?i)\b(?:password|passwd|pwd|otp|pin|secret|api[_-]?key|token)\b",
    "card": r"\b(?:\d{4}[ -]?){3}\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
}

# The second rule pack ----------------------------------------------------

STUDIO = {
    "phrases": [
        (r"\bremind\s+pannunga\b", "remind me"),
        (r"\bremind\s+pannu\b", "remind me"),
        (r"\bnyabagam\s+padutthu\b", "remind me"),
        (r"\bcall\s+pottu\s+kudu\b", "call"),
        (r"\bphone\s+pottu\s+kudu\b", "call"),
        (r"\bcall\s+pannu\b", "call"),
        (r"\bmessage\s+anuppu\b", "send message to"),
        (r"\bmessage\s+podu\b", "send message to"),
        (r"\balarm\s+vai(kka|kku)?\b", "set alarm"),
        (r"\balarm\s+set\s+pannu\b", "set alarm"),
        (r"\bvazhi\s+kaatu\b", "directions to"),
        (r"\broute\s+sollu\b", "route to"),
        (r"\bsearch\s+pannu\b", "search"),
        (r"\bopen\s+pannu\b", "open"),
        (r"\boff\s+pannu\b", "turn off"),
        (r"\bon\s+pannu\b", "turn on"),
        (r"\bkammi\s+pannu\b", "reduce"),
        (r"\bkuraikka?\b", "reduce"),
        (r"\bkoothu\b", "increase"),
        (r"\bethu?tthu\b", "increase"),
        (r"\beppadi\s+iruku\b", "how is"),
        (r"\beppadi\s+iruka\b", "how are you"),
        (r"\bkaalaila\b", "in the morning"),
        (r"\bmaniku\b", "o'clock"),
        (r"\bgym\s+poga\b", "go to the gym"),
        (r"\bsubmit\s+panna\b", "submit"),
        (r"\bsaapida\b", "take"),
        (r"\bmazhai\s+varuma\b", "will it rain"),
        (r"\benna\s+panra\b", "what are you doing"),
        (r"\blate\s+ah\s+varen\b", "I will come late"),
    ],
    # What each intent says. A part: slots to try in turn, the words around what is found, what stands there otherwise.
    "sentences": {
        "set_reminder": {"say": "Remind me to {task}{when}.", "parts": {"task": (["rest:set_reminder"], "{x}", "do this"), "when": (["times"], " {x}", "")}, "drop": ["remind", "me", "to", "in", "the", "o'clock", "a", "some"]},
        "set_alarm": {"say": "Set an alarm for {when}.", "parts": {"when": (["clock_day"], "{x}", "the morning")}},
        "make_call": {"say": "Call {whom}.", "parts": {"whom": (["person", "rest:make_call"], "{x}", "the contact")}, "drop": ["call", "to", "a"]},
        "send_message": {"say": "Send a message{whom}{body}.", "parts": {"whom": (["person"], " to {x}", ""), "body": (["saying"], " saying {x}", "")}, "drop": ["send", "message", "to", "a"]},
        "play_music": {"say": "Play {what}.", "parts": {"what": (["rest:play_music"], "{x}", "music")}, "drop": ["play", "podu"]},
        "check_weather": {"say": "{Title}?", "parts": {"Title": (["timeless"], "{x}", "")}},
        "open_app": {"say": "Open {what}.", "parts": {"what": (["app", "rest:open_app"], "{x}", "the app")}, "drop": ["open", "the", "a"]},
        "navigate": {"say": "Show me directions to {where}.", "parts": {"where": (["location", "rest:navigate"], "{x}", "the destination")}, "drop": ["directions", "route", "to"]},
        "device_control": {"say": "{do} the {what}{amount}.", "parts": {"do": (["action"], "{x}", ""), "what": (["device_setting"], "{x}", "setting"), "amount": (["amount"], " {x}", "")}},
        "search_info": {"say": "{Title}.", "parts": {"Title": (["timeless"], "{x}", "")}},
        "smalltalk": {"say": "{Title}?", "parts": {"Title": (["timeless"], "{x}", "")}},
        "unknown": {"say": "{Title}.", "parts": {"Title": (["all"], "{x}", "")}},
    },
    "words": {
        **dict.fromkeys([
    "dei", "da", "la", "pa", "ppa", "machi", "bruh", "ayya", "thala", "nu", "anna", "ku", "kku", "vendum",
], ""),
        "oru": "a", "konjam": "some", "sikkiram": "quickly", "semma": "good", "nalla": "good",
        "nalaiku": "tomorrow", "naalaikku": "tomorrow", "naalaiku": "tomorrow", "inniku": "today", "innaiku": "today",
        "ipo": "now", "ippo": "now", "raathiri": "tonight", "amma": "mother", "appa": "father", "thambi": "my brother", "akka": "my sister",
        "paatu": "song", "padal": "song", "song": "song", "podu": "play", "vanakkam": "hello", "sollu": "tell me", "sollunga": "tell me",
        "evlo": "how much", "enna": "what", "naan": "I", "ava": "AVA", "ondru": "a", "onnu": "a", "please": "please",
    },
    "local_verbs": [
    "pannu", "pannunga", "panna", "vai", "kudu", "anuppu", "iruku", "varuma", "maniku", "ku", "kku",
],
    "time_words": ["tomorrow", "today", "tonight", "now", "morning", "evening", "night"],
    "apps": ["whatsapp", "camera", "youtube", "instagram", "gallery", "spotify", "maps", "gmail"],
    "places": ["chennai", "coimbatore", "bangalore", "madurai", "office", "home", "college"],
    "devices": ["volume", "brightness", "wifi", "bluetooth", "torch", "flashlight"],
    "people": ["mother", "father", "my brother", "my sister", "sister", "friend", "wife", "husband"],
    "tasks": ["assignment", "medicine", "meeting"],
    "artists": ["ilayaraja", "rahman", "anirudh"],
    "english": (
        "remind me mother father not do never to the set alarm call message send play some open weather today tomorrow morning evening "
        "volume brightness wifi off on search route traffic meeting assignment submit gym music song songs please medicine bill electricity "
        "pay population sister friend phone camera am pm an a for is how tamil directions show turn"
    ).split(),
    "slang": [
    "dei", "da", "machi", "bruh", "semma", "la", "pa", "ayya", "thala",
],
    "polite": ["please", "pannunga", "sollunga", "kudunga"],
    "negation": r"(?i)\b(?:not|never|dont|don't|vendam|vendaam|pannathe|pannadha|pannadhe|pannaathe|koodathu)\b|வேண்டாம்|அழைக்காதே|செய்யாதே",
    "tamil": [
        ("அழைக்காதே", "do not call"), ("அழைக்க வேண்டாம்", "do not call"), ("அழை", "call"), ("அம்மாவுக்கு", "mother"), ("அம்மா", "mother"),
        ("அப்பாவுக்கு", "father"), ("அப்பா", "father"), ("நாளைக்கு", "tomorrow"), ("நாளை", "tomorrow"), ("இன்று", "today"),
        ("அலாரம்", "alarm"), ("வை", "set"), ("வாட்ஸ்அப்", "whatsapp"), ("திற", "open"),
    ],
    "intents": [
        ("set_reminder", r"\bremind\b", 0.95),
        ("set_alarm", r"\b(set )?alarm\b", 0.93),
        ("send_message", r"\bsend message\b|\bmessage\b", 0.88),
        ("make_call", r"\bcall\b", 0.92),
        ("play_music", r"\bplay\b|\bsong\b|\bmusic\b", 0.9),
        ("check_weather", r"\bweather\b|\brain\b", 0.9),
        ("navigate", r"\bdirections\b|\broute\b", 0.9),
        ("open_app", r"\bopen\b", 0.89),
        ("device_control", r"\b(volume|brightness|wifi|bluetooth|torch)\b", 0.91),
        ("search_info", r"\bsearch\b|\bhow much\b|\btell me\b|\btraffic\b", 0.82),
        ("smalltalk", r"\bhello\b|\bhow are you\b|\bwhat are you doing\b", 0.85),
    ],
}

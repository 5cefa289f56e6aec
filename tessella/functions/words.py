"""Word lists and tables that results depend on."""

#: Legal forms and filler of company names.
LEGAL = """
inc llc ltd limited limitee private pvt corp corporation co company llp plc
incorporated group holdings holding enterprises enterprise ventures venture
sarl sas sa sci scp snc eurl sasu societe ste
the and of for dba ms
""".split()

#: Business categories that tell little.
GENERIC = """
services service solutions solution center centre centers traders trading
partners partner associates associate consultants consulting consultant
industries industrial international global national
""".split()

#: Endings of web addresses that a squashed name loses.
TLD = "com net org in co io biz info us fr".split()

#: Address abbreviations.
STREET = {
    "rd": "road", "st": "street", "str": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "bd": "boulevard",
    "ln": "lane", "dr": "drive", "ct": "court", "cir": "circle", "pl": "place", "pkwy": "parkway", "hwy": "highway",
    "sq": "square", "ter": "terrace", "trl": "trail", "apt": "apartment", "ste": "suite", "fl": "floor", "flr": "floor",
    "bldg": "building", "rm": "room", "no": "number", "nr": "near", "opp": "opposite", "n": "north", "s": "south",
    "e": "east", "w": "west", "r": "rue", "bvd": "boulevard", "imp": "impasse", "all": "allee", "ch": "chemin",
}

#: Postal abbreviations of states, by country; names are written without spaces.
STATES = {
    "US": {
        "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado",
        "ct": "connecticut", "de": "delaware", "fl": "florida", "ga": "georgia", "hi": "hawaii", "id": "idaho",
        "il": "illinois", "in": "indiana", "ia": "iowa", "ks": "kansas", "ky": "kentucky", "la": "louisiana",
        "me": "maine", "md": "maryland", "ma": "massachusetts", "mi": "michigan", "mn": "minnesota", "ms": "mississippi",
        "mo": "missouri", "mt": "montana", "ne": "nebraska", "nv": "nevada", "nh": "newhampshire", "nj": "newjersey",
        "nm": "newmexico", "ny": "newyork", "nc": "northcarolina", "nd": "northdakota", "oh": "ohio", "ok": "oklahoma",
        "or": "oregon", "pa": "pennsylvania", "ri": "rhodeisland", "sc": "southcarolina", "sd": "southdakota",
        "tn": "tennessee", "tx": "texas", "ut": "utah", "vt": "vermont", "va": "virginia", "wa": "washington",
        "wv": "westvirginia", "wi": "wisconsin", "wy": "wyoming", "dc": "districtofcolumbia",
    },
    "India": {
        "ap": "andhrapradesh", "ar": "arunachalpradesh", "as": "assam", "br": "bihar", "cg": "chhattisgarh", "ga": "goa",
        "gj": "gujarat", "hr": "haryana", "hp": "himachalpradesh", "jh": "jharkhand", "ka": "karnataka", "kl": "kerala",
        "mp": "madhyapradesh", "mh": "maharashtra", "mn": "manipur", "ml": "meghalaya", "mz": "mizoram", "nl": "nagaland",
        "od": "odisha", "or": "odisha", "pb": "punjab", "rj": "rajasthan", "sk": "sikkim", "tn": "tamilnadu",
        "tg": "telangana", "ts": "telangana", "tr": "tripura", "up": "uttarpradesh", "uk": "uttarakhand",
        "ua": "uttarakhand", "wb": "westbengal", "dl": "delhi", "jk": "jammuandkashmir", "ch": "chandigarh",
        "py": "puducherry",
    },
}

#: Words that one source writes in an address and another leaves out.
ADDRESS_STOP = """
india usa france number door plot near opposite behind beside off
region district dist tq taluk tehsil po village city town township urban rural
na none nil unit
""".split()

#: Scripts other than Latin that names come in, with their first and last code points.
SCRIPTS = [
    ("Devanagari", 0x0900, 0x097F),
    ("Bengali", 0x0980, 0x09FF),
    ("Gurmukhi", 0x0A00, 0x0A7F),
    ("Gujarati", 0x0A80, 0x0AFF),
    ("Odia", 0x0B00, 0x0B7F),
    ("Tamil", 0x0B80, 0x0BFF),
    ("Telugu", 0x0C00, 0x0C7F),
    ("Kannada", 0x0C80, 0x0CFF),
    ("Malayalam", 0x0D00, 0x0D7F),
    ("Arabic", 0x0600, 0x06FF),
]

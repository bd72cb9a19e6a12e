"""Fixed values of the text rules. They have to equal those of the records' producers for right results."""

# Legal forms and their canonical tokens.
LEGAL = {
    "private": "pvt", "pvt": "pvt", "pte": "pvt", "limited": "ltd", "ltd": "ltd", "llp": "llp", "llc": "llc",
    "incorporated": "inc", "inc": "inc", "corporation": "corp", "corp": "corp", "co": "co", "company": "co", "compny": "co",
    "plc": "plc", "lp": "lp", "cie": "co", "compagnie": "co", "ets": "ets", "etablissements": "ets",
    "sarl": "sarl", "sas": "sas", "sasu": "sas", "sa": "sa", "eurl": "eurl", "sci": "sci", "societe": "ste", "ste": "ste",
    "gmbh": "gmbh", "bv": "bv", "srl": "srl",
}

# Words that a core name leaves out.
NAME_STOP = ["the", "and", "of", "de", "la", "le", "les", "du", "des", "et", "ms", "dba"]

# Address words.
ADDRESS = {
    "road": "rd", "rd": "rd", "street": "st", "st": "st", "str": "st", "avenue": "ave", "ave": "ave", "av": "ave",
    "boulevard": "blvd", "blvd": "blvd", "bd": "blvd", "drive": "dr", "dr": "dr", "lane": "ln", "ln": "ln", "court": "ct",
    "ct": "ct", "place": "pl", "pl": "pl", "suite": "ste", "ste": "ste", "highway": "hwy", "hwy": "hwy", "parkway": "pkwy",
    "pkwy": "pkwy", "north": "n", "south": "s", "east": "e", "west": "w", "apartment": "apt", "apt": "apt",
    "building": "bldg", "bldg": "bldg", "floor": "fl", "fl": "fl", "nagar": "ngr", "ngr": "ngr", "colony": "col",
    "sector": "sec", "sec": "sec", "near": "nr", "nr": "nr", "opposite": "opp", "opp": "opp", "district": "dist",
    "dist": "dist", "rue": "rue", "r": "rue", "chemin": "ch", "ch": "ch", "allee": "all", "impasse": "imp", "route": "rte",
    "rte": "rte", "cedex": "", "unit": "unit", "faubourg": "fbg", "fbg": "fbg", "quai": "qu", "cours": "crs",
    "square": "sq", "sq": "sq", "residence": "res", "res": "res", "batiment": "bat", "bat": "bat", "appartement": "apt",
    "etage": "fl", "centre": "ctr", "center": "ctr", "ctr": "ctr", "saint": "st", "sainte": "ste", "null": "", "none": "",
    "ndeg": "", "first": "1", "second": "2", "third": "3", "fourth": "4", "fifth": "5", "sixth": "6", "seventh": "7",
    "eighth": "8", "ninth": "9", "tenth": "10",
}

# Regions of one word.
REGIONS = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co",
    "connecticut": "ct", "delaware": "de", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il",
    "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md",
    "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt",
    "nebraska": "ne", "nevada": "nv", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa",
    "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa",
    "wisconsin": "wi", "wyoming": "wy", "assam": "as", "bihar": "br", "chhattisgarh": "cg", "goa": "ga", "gujarat": "gj",
    "haryana": "hr", "jharkhand": "jh", "karnataka": "ka", "kerala": "kl", "maharashtra": "mh", "manipur": "mn",
    "meghalaya": "ml", "mizoram": "mz", "nagaland": "nl", "odisha": "od", "orissa": "od", "punjab": "pb",
    "rajasthan": "rj", "sikkim": "sk", "telangana": "ts", "tripura": "tr", "uttarakhand": "uk", "delhi": "dl",
    "chandigarh": "ch", "puducherry": "py", "pondicherry": "py", "occitanie": "occ", "bretagne": "bre", "normandie": "nor",
}

# Regions of several words, longest first.
REGION_PHRASES = {
    "provence alpes cote d azur": "paca", "bourgogne franche comte": "bfc", "auvergne rhone alpes": "ara",
    "district of columbia": "dc", "centre val de loire": "cvl", "nouvelle aquitaine": "naq", "arunachal pradesh": "ar",
    "jammu and kashmir": "jk", "himachal pradesh": "hp", "pays de la loire": "pdl", "hauts de france": "hdf",
    "andhra pradesh": "ap", "madhya pradesh": "mp", "north carolina": "nc", "south carolina": "sc", "new hampshire": "nh",
    "uttar pradesh": "up", "west virginia": "wv", "ile de france": "idf", "north dakota": "nd", "south dakota": "sd",
    "rhode island": "ri", "nct of delhi": "dl", "west bengal": "wb", "new jersey": "nj", "new mexico": "nm",
    "tamil nadu": "tn", "grand est": "ges", "new delhi": "dl", "new york": "ny",
}

# Digits that stand for letters.
LOOK_ALIKE = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b"}

# Rewrites of a consonant skeleton, in order.
SKELETON = [("ph", "f"), ("([kgcjtdbsr])h", "$1"), ("w", "v"), ("[qc]", "k"), ("z", "j"), ("x", "ks"), ("[aeiouy]", ""), (r"(.)\1+", "$1"), (r"\s+", " ")]

# What a web address or an appended number adds to a name.
WEB = r"^(?:https?://)?(?:www\.)?@?"
TOP_LEVEL = r"\.(?:com|net|org|in|co|fr|io|biz|info|us)(?:\.[a-z]{2})?$"
TRAILING_ID = r"[\s\-#:]*\d{6,}$"

# Key types with their weight and channel (0 name, 1 address).
KEY_TYPES = {"n": ("1.0", 0), "b": ("1.0", 0), "p": ("0.5", 0), "a": ("0.4", 1), "z": ("1.5", 1), "c": ("0.8", 1), "x": ("1.0", 1), "k": ("0.8", 0), "e": ("1.5", 0), "s": ("0.5", 0)}

"""Fixed values of the study design.

Everything in this file is a fixed value that results depend on: name lists, lookup
tables, patterns and level orders. They are data, not logic.
"""

# --- fixed values: sample-id patterns -------------------------------------------------
NEGATIVE_PATTERN = "CB|FB|EB|Negative"
POSITIVE_PATTERN = "Positive"
CAPTIVE_PATTERN = "HWP|WWT"
TIME_COURSE_PATTERN = "THL"
CONTROL_TYPES = [
    ("CB", "Field"),
    ("FB", "Filtration"),
    ("EB", "Extraction"),
    ("Negative", "PCR"),
]
CONTROL_LEVELS = ["Field", "Filtration", "Extraction", "PCR"]
SAMPLE_TYPES = [("P0", "Stratified"), ("T0", "Directed")]
SAMPLE_TYPE_LEVELS = ["Directed", "Stratified", "Other"]
SITES = [("BAM", "Bamff Estate"), ("TM", "Thorne Moors")]
OTHER_SITE = "Tophill Low Nature Reserve"

# --- fixed values: taxonomy filters ---------------------------------------------------
VERTEBRATE_PATTERN = "Chordata|unassigned"
SPECIES_LEVEL_PATTERN = " |Anas|Emberiza|Larus"
TARGET_PATTERN = (
    "Lutra|Arvicola|Castor|Lynx|Erinaceus|Meles|Cervus|Sciurus vulgaris|Martes"
)
UNASSIGNED = "unassigned"
CONTROL_SPECIES = "Maylandia zebra"
SPURIOUS_TAXA = [
    "Pinicola enucleator",
    "Schoeniclus rusticus",
    "Atherina boyeri",
    "Bos mutus",
    "Chordata environmental sample",
    "Pan",
    "Sardina pilchardus",
]

# --- fixed values: name corrections (from, to) ----------------------------------------
SYNONYMS = [
    ("Anas carolinensis", "Anas"),
    ("Buteo", "Buteo buteo"),
    ("Canis lupus", "Canis lupus familiaris"),
    ("Castor", "Castor fiber"),
    ("Emberiza chrysophrys", "Emberiza"),
    ("Larus glaucoides", "Larus"),
    ("Pelophylax", "Pelophylax ridibundus"),
    ("Sus scrofa", "Sus scrofa domesticus"),
    ("Triturus", "Triturus cristatus"),
    ("Bison", "Bison bonasus"),
    ("Bos", "Bos taurus"),
    ("Cichlidae", "Maylandia zebra"),
    ("Haplochromis burtoni", "Maylandia zebra"),
    ("Lynx pardinus", "Lynx lynx"),
    ("Meleagris", "Meleagris gallopavo"),
    ("Oreochromis niloticus", "Maylandia zebra"),
    ("Pundamilia nyererei", "Maylandia zebra"),
    ("Sprattus", "Sprattus sprattus"),
    ("Strix", "Strix aluco"),
]

# --- fixed values: enclosures, the species they house and its lifestyle ---------------
ENCLOSURES = [
    ("OTT", "Lutra lutra", "Semi-aquatic"),
    ("WV", "Arvicola amphibius", "Semi-aquatic"),
    ("BEAV", "Castor fiber", "Semi-aquatic"),
    ("BAD", "Meles meles", "Ground-dwelling"),
    ("DEER", "Cervus elaphus", "Ground-dwelling"),
    ("HH", "Erinaceus europaeus", "Ground-dwelling"),
    ("LYNX", "Lynx lynx", "Ground-dwelling"),
    ("PM", "Martes martes", "Arboreal"),
    ("SQ", "Sciurus vulgaris", "Arboreal"),
]
# A squirrel-enclosure sample taken from a bath used by badgers.
SHARED_SAMPLE = ("HWP-Round01-SQ-BATH", "Meles meles", "BAD", "Ground-dwelling")
UNMASKED_SAMPLES = ["HWP-Round01-SQ-BATH"]
LIFESTYLE_LEVELS = ["Semi-aquatic", "Ground-dwelling", "Arboreal"]
CAPTIVE_SPECIES_LEVELS = [
    "Arvicola amphibius",
    "Castor fiber",
    "Lutra lutra",
    "Erinaceus europaeus",
    "Meles meles",
    "Lynx lynx",
    "Cervus elaphus",
    "Sciurus vulgaris",
    "Martes martes",
]

# --- fixed values: sample-number labels -----------------------------------------------
SAMPLE_NUMBER_LABELS = [
    ("P0([1-6])", "STR0$1"),
    ("T0([1-6])", "DIR0$1"),
    ("1IND", "QUAR1"),
    ("4IND", "QUAR2"),
]

# --- fixed values: behaviour classes --------------------------------------------------
WATER_CONTACT = ["Drinking", "Swimming", "Immersed", "Sniffing", "Urinating"]
NO_WATER_CONTACT = [
    "None",
    "Defecating",
    "Feeding",
    "Walking",
    "Standing",
    "Resting",
    "Grooming",
]

# --- fixed values: vertebrate groups of the wild taxa, in report order ----------------
AMPHIBIANS = [
    "Bufo bufo",
    "Rana temporaria",
    "Pelophylax ridibundus",
    "Lissotriton helveticus",
    "Lissotriton vulgaris",
    "Triturus cristatus",
]
FISH = [
    "Anguilla anguilla",
    "Gasterosteus aculeatus",
    "Pungitius pungitius",
    "Salmo trutta",
    "Ctenopharyngodon idella",
]
BIRDS = [
    "Anas",
    "Gallinula chloropus",
    "Larus",
    "Ardea cinerea",
    "Parus major",
    "Emberiza",
    "Turdus philomelos",
    "Sturnus vulgaris",
    "Garrulus glandarius",
    "Pica pica",
    "Strix aluco",
    "Buteo buteo",
    "Columba livia",
    "Columba oenas",
    "Phasianus colchicus",
    "Meleagris gallopavo",
]
MAMMALS = [
    "Arvicola amphibius",
    "Neomys fodiens",
    "Rattus norvegicus",
    "Castor fiber",
    "Sorex araneus",
    "Myodes glareolus",
    "Oryctolagus cuniculus",
    "Capreolus capreolus",
    "Cervus elaphus",
    "Canis lupus familiaris",
    "Sus scrofa domesticus",
    "Ovis aries",
    "Bos taurus",
    "Pipistrellus pipistrellus",
    "Sciurus carolinensis",
]
# Species of the site-by-pond method comparison, in report order.
METHOD_SPECIES_LEVELS = [
    "Arvicola amphibius",
    "Neomys fodiens",
    "Rattus norvegicus",
    "Neovison vison",
    "Castor fiber",
    "Lutra lutra",
    "Sorex araneus",
    "Myodes glareolus",
    "Oryctolagus cuniculus",
    "Lepus europaeus",
    "Mustela erminea",
    "Mustela nivalis",
    "Meles meles",
    "Vulpes vulpes",
    "Muntiacus reevesi",
    "Capreolus capreolus",
    "Cervus elaphus",
    "Sus scrofa",
    "Canis lupus familiaris",
    "Sus scrofa domesticus",
    "Ovis aries",
    "Bos taurus",
    "Pipistrellus pipistrellus",
    "Sciurus carolinensis",
    "Sciurus vulgaris",
]
# Lifestyle of wild and surveyed mammals; every other mammal is ground-dwelling.
SEMI_AQUATIC = [
    "Arvicola amphibius",
    "Castor fiber",
    "Neomys fodiens",
    "Rattus norvegicus",
    "Lutra lutra",
    "Neovison vison",
]
ARBOREAL = ["Pipistrellus pipistrellus", "Sciurus carolinensis", "Sciurus vulgaris"]

# --- fixed values: species not expected at a site (site, species) ---------------------
NOT_EXPECTED = [
    ("Bamff Estate", "Muntiacus reevesi"),
    ("Bamff Estate", "Mustela erminea"),
    ("Bamff Estate", "Mustela nivalis"),
    ("Bamff Estate", "Arvicola amphibius"),
    ("Bamff Estate", "Neovison vison"),
    ("Bamff Estate", "Lepus europaeus"),
    ("Bamff Estate", "Oryctolagus cuniculus"),
    ("Bamff Estate", "Sciurus carolinensis"),
    ("Bamff Estate", "Bos taurus"),
    ("Thorne Moors", "Sciurus vulgaris"),
    ("Thorne Moors", "Castor fiber"),
    ("Thorne Moors", "Lutra lutra"),
    ("Thorne Moors", "Neovison vison"),
    ("Thorne Moors", "Sus scrofa"),
    ("Thorne Moors", "Oryctolagus cuniculus"),
    ("Thorne Moors", "Lepus europaeus"),
    ("Thorne Moors", "Sciurus carolinensis"),
    ("Thorne Moors", "Bos taurus"),
    ("Tophill Low Nature Reserve", "Sciurus vulgaris"),
    ("Tophill Low Nature Reserve", "Cervus elaphus"),
    ("Tophill Low Nature Reserve", "Muntiacus reevesi"),
    ("Tophill Low Nature Reserve", "Castor fiber"),
    ("Tophill Low Nature Reserve", "Sus scrofa"),
]
NOT_EXPECTED_AT_POND = [("Thorne Moors", "Arvicola amphibius", "Pond 1")]

# --- fixed values: read-processing parameters -----------------------------------------
PRIMER_BASES = 18
TRIM_QUALITY = 30
READ_CROP = 110
TRIM_MIN_LENGTH = 90
PRODUCT_LENGTH = 110
LENGTH_FILTER = 100
MIN_CLUSTER_READS = 3
MIN_IDENTITY = 0.98
MIN_COVERAGE = 0.8

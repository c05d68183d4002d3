"""Fixed values.

Everything in this file is data, not logic: word lists, ordered rule tables,
patterns and sentence formats whose exact wording decides the result of a
query.  They are kept together, in plain text and in their natural order, so
that the code elsewhere holds only the logic.
"""

# --- sentiment classes -------------------------------------------------------

CLASSES = ["negative", "neutral", "positive"]

# --- review themes: theme -> keywords, first four hits are reported ----------

STRENGTH_THEMES = {
    "easy to use or set up": ["easy", "simple", "setup", "set up", "user friendly"],
    "clear screen or picture": ["screen", "display", "picture", "resolution", "clear"],
    "good for family use": ["kid", "kids", "child", "children", "family"],
    "useful for everyday needs": ["useful", "works", "handy", "daily", "everyday"],
    "portable or easy to carry": ["portable", "light", "lightweight", "carry"],
    "good basic build quality": ["quality", "solid", "sturdy", "build"],
    "familiar product format": ["battery", "batteries", "charger", "adapter", "cable", "case"],
}

CONCERN_THEMES = {
    "setup or connection issues": ["wifi", "connect", "connection", "setup", "pairing"],
    "battery life concerns": ["battery", "drain", "charge", "charging"],
    "slow performance": ["slow", "lag", "freeze", "frozen"],
    "screen or display issues": ["screen", "display", "crack", "resolution"],
    "app or content limitations": ["app", "content", "ads", "advertisement"],
    "defective or dead-on-arrival units": ["defective", "dead", "broken", "stopped working"],
    "power or charging problems": ["power", "charger", "charging", "adapter"],
}

# --- product names -----------------------------------------------------------

# Removed one after the other, as substrings, in this order.
CANONICAL_PHRASES = [
    "includes special offers", "with special offers", "without special offers", "special offers",
    "certified refurbished", "previous generation", "brand new", "high resolution",
    "touchscreen", "display", "wifi", "wi fi", "alexa", "amazon", "kindle", "fire",
    "case", "cover", "kid proof", "kids edition", "edition",
]

CANONICAL_PATTERNS = [
    r"\b\d+\s*gb\b",
    r"\b\d+\s*ppi\b",
    r"\b(black|white|blue|red|green|magenta|tangerine|silver|merlot|yellow)\b",
    r"\b(6|7|8|10)\s*(inch|inches|in)\b",
]

# Product families: (terms, excluded terms, family).  The first rule with a term
# in the name and no excluded term wins.
FAMILY_RULES = [
    (["battery", "batteries", "alkaline"], [], "family_accessory_battery"),
    (["power adapter", "charger", "charging cable", "powerfast", "adapter", "cable", "speaker wire"], [],
     "family_accessory_power_charger"),
    (["kids edition tablet", "kid-proof case"], [], "family_fire_tablet"),
    (["sleeve", "case", "cover", "screen protector", "protector", "stand", "bag", "keyboard"], [],
     "family_accessory_case_cover"),
    (["fire tablet", "fire hd", "kindle fire", "fire 7", "fire 16gb"], [], "family_fire_tablet"),
    (["fire tv", "fire stick", "streaming media", "streaming player"], [], "family_fire_tv_streaming"),
    (["paperwhite", "voyage", "oasis", "e-reader", "ereader"], [], "family_kindle_ereader"),
    (["kindle"], ["fire"], "family_kindle_ereader"),
    (["echo", "alexa", "amazon tap", "bluetooth speaker", "speaker"], [], "family_echo_alexa_speaker"),
    (["file folder", "document organizer", "backpack", "binder", "pet", "kennel", "litter", "cat", "dog",
      "hot handle", "coconut water", "red tea", "nespresso pod storage drawer"], [], "family_non_electronic"),
    (["amazonbasics"], [], "family_accessory_general"),
]
FAMILY_DEFAULT = "family_other_amazon_product"

# Word in the name -> helper token, in this order.
WORD_TOKENS = [
    ("tablet", "word_tablet"), ("touchscreen", "word_touchscreen"), ("display", "word_display"),
    ("screen", "word_screen"), ("kids", "word_kids"), ("kid", "word_kids"),
    ("e-reader", "word_ereader"), ("ereader", "word_ereader"), ("paperwhite", "word_paperwhite"),
    ("voyage", "word_voyage"), ("oasis", "word_oasis"), ("echo", "word_echo"), ("alexa", "word_alexa"),
    ("speaker", "word_speaker"), ("tap", "word_tap"), ("fire tv", "word_fire_tv"),
    ("fire stick", "word_fire_stick"), ("streaming", "word_streaming"), ("remote", "word_remote"),
    ("battery", "word_battery"), ("batteries", "word_battery"), ("alkaline", "word_alkaline"),
    ("aa", "word_aa"), ("aaa", "word_aaa"), ("charger", "word_charger"), ("adapter", "word_adapter"),
    ("power", "word_power"), ("cable", "word_cable"), ("case", "word_case"), ("cover", "word_cover"),
    ("sleeve", "word_sleeve"), ("bag", "word_bag"), ("keyboard", "word_keyboard"), ("stand", "word_stand"),
    ("protector", "word_protector"), ("pet", "word_pet"), ("dog", "word_dog"), ("cat", "word_cat"),
    ("kennel", "word_kennel"), ("litter", "word_litter"), ("folder", "word_folder"),
    ("document", "word_document"), ("nespresso", "word_nespresso"),
]

# Taxonomy: (tested text, terms, excluded terms, category, reason), first hit wins.
# "name" tests the product name, "both" tests name and category text together.
TAXONOMY_RULES = [
    ("name", ["fire tv", "fire stick", "streaming media", "streaming player"], [],
     "Fire TV & Streaming", "matched Fire TV/streaming product name"),
    ("both", ["file folder", "document organizer", "pet", "kennel", "litter", "cat", "dog", "hot handle",
              "coconut water", "red tea", "nespresso pod storage drawer", "backpack", "binder"], [],
     "Non-Electronics", "matched non-electronic product terms"),
    ("both", ["battery", "batteries", "alkaline", " aa ", " aaa "], [],
     "Electronic Accessories", "matched battery/accessory terms"),
    ("both", ["power adapter", "charger", "charging cable", "powerfast", "speaker wire"], [],
     "Electronic Accessories", "matched power/wire accessory terms"),
    ("both", ["fire tablet", "fire hd", "kindle fire", "fire 7", "fire 16gb", "kids edition tablet",
              "kid-proof case"], [],
     "Fire Tablets", "matched Fire tablet terms"),
    ("both", ["charger", "charging", "powerfast", "adapter", "cable", "case", "cover", "sleeve", "stand",
              "dock", "keyboard", "screen protector", "protector", "replacement", "mount"], [],
     "Electronic Accessories", "accessory term overrides device-family terms"),
    ("both", ["fire tv", "fire stick", "streaming media", "streaming player"], [],
     "Fire TV & Streaming", "matched Fire TV/streaming terms"),
    ("name", ["amazon tap", "echo", "alexa", "bluetooth speaker", "speaker"], [],
     "Echo & Alexa Devices", "matched Echo/Alexa/speaker product name"),
    ("both", ["oasis", "paperwhite", "voyage", "e-reader", "ereader"], [],
     "Kindle E-Readers", "matched Kindle/e-reader terms"),
    ("name", ["kindle"], ["fire"],
     "Kindle E-Readers", "matched Kindle/e-reader terms"),
]
TAXONOMY_DEFAULT_REASON = "no taxonomy rule matched"

# Product types: (tested text, terms, type), first hit wins.
PRODUCT_TYPE_RULES = [
    ("both", ["fire tv", "streaming"], "streaming product"),
    ("both", ["echo", "alexa", "speaker"], "smart speaker product"),
    ("both", ["kindle", "e-reader", "ereader"], "e-reader"),
    ("both", ["fire tablet", "tablet"], "tablet"),
    ("both", ["battery", "charger", "adapter", "cable", "case"], "electronic accessory"),
    ("category", ["non"], "non-electronic product"),
]
PRODUCT_TYPE_DEFAULT = "consumer product"

# --- which themes fit which product -------------------------------------------

BATTERY_WORDS = ["battery", "batteries"]
SCREEN_NAME_WORDS = ["show", "screen", "display", "tablet", "kindle", "e-reader"]
SCREEN_THEME_WORDS = ["screen", "picture", "display"]

BATTERY_STRENGTHS = ["useful for everyday needs", "familiar product format", "good basic build quality"]
ACCESSORY_BLOCKED_STRENGTHS = ["screen", "picture", "display", "family"]
NO_STRENGTHS = "useful for this product type"
NO_BATTERY_STRENGTHS = "useful for everyday battery needs"
NO_ACCESSORY_STRENGTHS = "useful for this accessory type"

BATTERY_CONCERNS = ["battery life concerns", "defective or dead-on-arrival units"]
ACCESSORY_BLOCKED_CONCERNS = ["screen", "display", "app", "content", "slow performance"]
NO_CONCERNS = "limited repeated complaint themes"
NO_BATTERY_CONCERNS = "some customers question battery life or consistency"
NO_ACCESSORY_CONCERNS = "reliability concerns may matter for some buyers"

# --- sentences of the cards ---------------------------------------------------

COMPARISON_NOTES = {
    "volume": ("review volume is above or around the category middle",
               "review volume is below the category middle"),
    "rating": ("average rating is strong compared with similar listed products",
               "average rating is still useful but below some similar listed products"),
    "risk": ("complaint signals are worth comparing carefully",
             "complaint signals are lower than several similar listed products"),
}

STYLE_ANGLES = [
    "Lead with the kind of shopper this product fits.",
    "Lead with why the product feels easy to live with.",
    "Lead with the product's practical role in a normal buying decision.",
    "Lead with the balance between appeal and possible concerns.",
    "Lead with what makes the product a sensible shortlist candidate.",
]

RECOMMENDATION = "worth considering if the listed concerns are acceptable"

# %s parts are filled in order.
EVIDENCE_SENTENCE = "It has %s reviews, averages %s/5, and %s%% of reviews are positive."

TEMPLATE_CARD = {
    "headline": "Evidence-Based Shopper Review",
    "summary": (
        "%s is a %s for shoppers comparing options in %s. "
        "It has %s reviews, averages %s/5, and %s%% of reviews are positive.\n\n"
        "Customers mainly respond well to %s. This gives the product a useful starting point, "
        "especially when the buyer wants something practical and easy to compare.\n\n"
        "The main concerns are %s. Compared with similar listed products, %s. "
        "Overall, it is worth considering if those concerns are acceptable."
    ),
    "best_for": "Choose this if the product type fits your need and the concerns are acceptable.",
    "source": "simple_backup_no_llm",
}

FALLBACK_REVIEW = (
    "%s has %s reviews, averages %s/5, and %s%% of reviews are positive. "
    "Customers mainly mention %s as strengths. The main complaints or issues are %s. "
    "Overall, it is worth comparing with similar products using the score, "
    "rating, review volume, and evidence strength shown above."
)
FALLBACK_PROS = "its practical everyday use"
FALLBACK_CONS = "no repeated complaint clearly stood out"
BROKEN_SUMMARY_MARKS = ["<div", "rr-stat-grid"]

CLUSTER_NOTE = "cluster_size means number of products, not review rows"

# --- product images -----------------------------------------------------------

IMAGE_NOISE_PATTERNS = [
    r"\b(includes|special|offers|with|without|packaging|may|vary)\b",
    r"\b(previous|generation|release|certified|refurbished|brand|new)\b",
    r"\b(color|free|shipping|powered|dolby|improved|sound|design|finish)\b",
]
IMAGE_STOP_TOKENS = ["amazon", "amazonbasics", "includes", "special", "offers", "with", "and", "the", "for",
                     "black", "white", "new", "all"]
BLOCKED_URL_MARKS = ["barcode", "upccode", "_ss40_", "_ss40", "._ss40", "_sl75_", "_sl160_"]

# (markers, points): points are added once when any marker is in the lower-case URL.
URL_POINTS = [
    (["images-na.ssl-images-amazon.com", "m.media-amazon.com"], 10),
    (["bbystatic.com", "bhphoto.com"], 8),
    (["_sl"], 12),
    (["_sx", "_sy", "_ux", "_uy"], 6),
    (["ss40", "thumb"], -80),
]
URL_DIMENSION_PATTERNS = [r"_(?:sl|sx|sy|ux|uy|ac_sl)(\d+)", r"s-l(\d+)"]

# A loose image match must agree on the first family whose words are all in the product text.
IMAGE_FAMILY_WORDS = [
    ["paperwhite"], ["voyage"], ["kindle"], ["fire", "tv"], ["fire", "stick"], ["fire", "tablet"],
    ["echo"], ["alexa"], ["battery"], ["batteries"], ["keyboard"], ["cable"], ["wire"], ["adapter"],
    ["folder"], ["litter"], ["kennel"], ["crate"],
]

# Name without an own image -> names whose image may be used, best first.
IMAGE_ALIASES = {
    "echo white": [
        "Amazon Echo ‚Äì White",
        "Amazon Echo (1st Generationcertified) Color:White Free Shipping",
    ],
    "echo black": [
        "Certified Refurbished Amazon Echo",
        "Echo Dot (Previous generation)",
    ],
    "amazon amazon tap portable bluetooth and wi fi speaker": [
        "Amazon Tap - Alexa-Enabled Portable Bluetooth Speaker",
        "Amazon Tap Smart Assistant Alexaenabled (black) Brand New",
    ],
    "amazon tap portable bluetooth and wi fi speaker black": [
        "Amazon Tap - Alexa-Enabled Portable Bluetooth Speaker",
        "Amazon Tap Smart Assistant Alexaenabled (black) Brand New",
    ],
    "amazon fire tv": [
        "Amazon Fire TV with 4K Ultra HD and Alexa Voice Remote (Pendant Design) | Streaming Media Player",
        "Amazon Fire TV Gaming Edition Streaming Media Player",
        "Certified Refurbished Amazon Fire TV with Alexa Voice Remote",
    ],
    "amazon echo and fire tv power adapter": [
        "Amazon 9W PowerFast Official OEM USB Charger and Power Adapter for Fire Tablets and Kindle eReaders",
        "Amazon Kindle Charger Power Adapter Wall Charger And Usb Cable Micro Usb Cord",
    ],
    "certified refurbished amazon fire tv stick": [
        "Fire TV Stick Streaming Media Player Pair Kit",
    ],
    "amazon fire hd 8 8in tablet 16gb b018szt3bk 6th gen android": [
        "All-New Fire HD 8 Tablet, 8 HD Display, Wi-Fi, 16 GB - Includes Special Offers, Black",
        "Amazon Fire HD 8 with Alexa (8\" HD Display Tablet)",
    ],
    "kindle paperwhite": [
        "All-New Kindle E-reader - Black, 6\" Glare-Free Touchscreen Display, Wi-Fi - Includes Special Offers",
        "Amazon Kindle E-Reader 6\" Wifi (8th Generation, 2016)",
    ],
    "amazon kindle paperwhite ebook reader 4 gb 6 monochrome paperwhite touchscreen wi fi black": [
        "All-New Kindle E-reader - Black, 6\" Glare-Free Touchscreen Display, Wi-Fi - Includes Special Offers",
        "Amazon Kindle E-Reader 6\" Wifi (8th Generation, 2016)",
    ],
    "kindle keyboard": [
        "AmazonBasics Bluetooth Keyboard for Android Devices - Black",
    ],
    "amazon kindle fire hd 3rd gen 8gb": [
        "All-New Fire HD 8 Tablet, 8 HD Display, Wi-Fi, 16 GB - Includes Special Offers, Black",
        "Fire Tablet, 7 Display, Wi-Fi, 8 GB - Includes Special Offers, Black",
    ],
    "certified refurbished amazon fire tv 1st": [
        "Certified Refurbished Amazon Fire TV with Alexa Voice Remote",
        "Amazon Fire TV Gaming Edition Streaming Media Player",
    ],
}

# --- file input ---------------------------------------------------------------

# Cell texts that count as missing.
MISSING_TEXTS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
                 "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

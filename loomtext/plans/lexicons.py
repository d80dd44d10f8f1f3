"""Stand-in lexicons of the test tables' invented languages, and other parameters that queries and their SQL share."""

TONGUES = {
    "french": ("que", "pour", "les", "eau", "dans"),
    "german": ("und", "sch", "der", "nicht", "keit"),
    "spanish": ("ción", "los", "por", "ez", "las"),
    "english": ("the", "and", "with", "tion", "was"),
}
TERMS = ("theat", "tion", "ereau", "sching", "ando", "miento", "ning", "handed", "ver", "les")
TERM_LETTERS = "[a-zA-Zäöüßéèêçñóíáú]+"
RENDERINGS = {"tion": ("ation", "Tion", "ition"), "eau": ("eaux", "Eau"), "schein": ("schei", "keit"), "and": ("And", "ande")}
FRAGMENTS = {"alpha": ("src0", "src11"), "beta": ("src1", "src2"), "gamma": ("src3",), "delta": ("9",)}
TIERS, PERIODS = {"alpha": 4, "beta": 3, "gamma": 3}, {"alpha": "Tantric", "beta": "Classical", "gamma": "Classical"}
LEVELS = ("exact", "near_duplicate", "paraphrase", "in_domain")
REGISTERS = ("literal", "plain", "precise", "natural")
INSTRUCTIONS = {
    "literal": "Translate literally, keeping the order of the words.",
    "plain": "Translate into plain, simple language.",
    "precise": "Translate with precision, keeping terms exact.",
    "natural": "Translate naturally.",
}

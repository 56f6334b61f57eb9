"""Patterns of the text functions, in Java syntax.

Fixed values: the word lists, marks and limits below decide results and are part
of the behaviour that queries rely on.
"""

SPACES = r"(?U)\s+"
ENDS = r"(?U)^\s+|\s+$"
AFTER_SENTENCE = r"(?U)(?<=[.?!])\s+"
AFTER_SENTENCE_SHOWN = r"(?U)(?<=[.!?])\s+"

REPLACEMENT = ("�", "")
#: Glyphs that stand for a bullet; the last six are from the private-use area of symbol fonts.
BULLETS = ("[▯□●▪▸❖❑✓✗•‣⁃\uf0a7\uf0b7\uf0a8\uf0fc\uf0a4\uf0d8]", "• ")
NUMBER_LINES = (r"(?Umd)^\s*\d{1,3}\s*$", "")
SITE_MARKS = (r"(?U)\s*\([AB]\)\s*", " ")
LEADING_NUMBER = (r"(?U)^\d{1,3}\s+(?=[A-Z])", "")
BROKEN_WORDS = (
    ("at t he", "at the"),
    ("alg orithm", "algorithm"),
    ("e -mail", "email"),
    ("radix -64", "radix-64"),
    ("key -exchange", "key-exchange"),
    ("Phase -1", "Phase-1"),
    ("Phase -2", "Phase-2"),
    ("Change -cipher", "Change-cipher"),
    ("non -threatening", "non-threatening"),
    ("malici ous", "malicious"),
)
BROKEN = tuple((rf"(?iuU)\b{a}\b", b) for a, b in BROKEN_WORDS)
SPLIT_WORDS = (r"(?iuU)\b(soft|hard|fire|net|data|mal|cyber)\s+(ware|wall|work|base|icious|security)\b", "$1$2")
HYPHENS = ((r"(?U)(\w)\s+-\s+(\w)", "$1-$2"), (r"(?U)(\w)\s+-(\w)", "$1-$2"), (r"(?U)(\w)-\s+(\w)", "$1-$2"))
BLANKS = (" {2,}", " ")
BEFORE_PUNCTUATION = (r"(?U)\s+([.,;:!?])", "$1")

DEFINITION_START = r"(?iuU)^\s*(what\s+is|what\s+are|what\s+does|define|meaning\s+of|definition\s+of)\b"
DEFINITION_PHRASE = r"(?iuU)\b(stands?\s+for|means?|refers?\s+to|definition\s+of|meaning\s+of)\b"
LIST_PHRASE = (
    r"(?iuU)\b(what\s+are|list|types?\s+of|kinds?\s+of|examples?\s+of|categories\s+of|approaches\s+to|steps\s+(?:in|of|to|taken|that|which|the)|phases\s+of|ways\s+to|"
    r"services\s+of|benefits?\s+of|symptoms?\s+of|disadvantages\s+of|advantages\s+of|requirements\s+(?:in|of|for))\b"
)
LIST_SUFFIX = (
    r"(?iuU)\b(protocols|services|types|kinds|examples|approaches|phases|benefits|methods|techniques|ways|requirements|symptoms|disadvantages|advantages|features|categories|"
    r"properties|functionalities|aspects|fields|steps)\s*\??\s*$"
)
LEADER = r"(?iuU)^\s*(what\s+is|what\s+are|what\s+does|define|meaning\s+of|definition\s+of)\s+"
ARTICLE = r"(?iuU)^\s*(a|an|the)\s+"
TRAILING_VERB = r"(?iuU)\s+(stand\s+for|stands\s+for|mean|means|refer\s+to|refers\s+to).*$"
TRAILING_PLACE = r"(?iuU)\s+(?:in|inside|within|used\s+in|used\s+by)\s+\w+(?:\s+\w+)?\s*$"
ACRONYM = r"(?U)\b([A-Z]{2,6})\b"
BOOST_VERBS = r"\s+(?:is|are|stands\s+for|refers\s+to|can\s+be\s+defined\s+as|means)\b"
DEFINITION_VERBS = (
    r"stands?\s+for",
    r"refers?\s+to",
    r"can\s+be\s+defined\s+as",
    r"means?",
    r"is\s+a\b|is\s+an\b|is\s+the\b|is\s+defined",
    r"are\s+a\b|are\s+the\b|are\s+defined",
    r"is|are",
)

# Fixed values of lists: words that don't tell which list a question is about, what leads into a list, what marks
# an item, where lines break before one, the first sentence of an item, inline lists, and the lengths allowed.
LIST_STOP_WORDS = {
    "what", "are", "is", "the", "a", "an", "of", "in", "at", "on", "for", "with", "and", "or", "how", "do", "does", "to", "list", "kinds", "examples", "taken", "takes", "take", "by",
    "that", "which", "some", "few", "this", "these", "those",
}
LIST_LEAD = r"(?U)(?:^|(?<=[.!?]\s))([A-Z][^\n.!?]{4,150}?):(\s+)"
LIST_LOST_BULLET = r"(?U)(^|\s)o\s+(?=[A-Z])"
LIST_BREAK = r"(?U)\n|(?<=\S)\s+(?=•|\d+[.)]\s)"
LIST_ITEM = r"(?Ud)^(?:•|[-*]|\d+[.)])\s*(.+)$"
LIST_FIRST_SENTENCE = r"(?Ud)^(.{5,250}?[.!?])(?:\s+[A-Z]|\s*$)"
LIST_OPENER = r"(?isU)^.*\b(?:(?:some\s+)?types?\s+of\s+\w+|kinds?\s+of\s+\w+|examples?\s+of\s+\w+|categories\s+of\s+\w+|are\s+as\s+follows|include[s]?|are)\s*:\s*"
LIST_INLINE = r"(?U)(?:^|(?<=[.!?]\s))([A-Z][A-Za-z][\w\s\-/]{1,40}):\s+([^.!?]{10,250}?[.!?])"
LIST_LONGEST, LIST_PLAIN_LONGEST, LIST_INLINE_LONGEST, LIST_TITLE_WORDS, LIST_MOST = 250, 200, 280, 6, 10
NOT_FOUND = "The uploaded documents do not contain enough information to answer this question."
TOP_K, TOP_K_FIRST, THRESHOLD, GATE = 8, 5, 0.25, 0.80
CONTEXT_SECTIONS, CONTEXT_WORDS, CONTEXT_LEAST = 5, 1500, 20
CHUNK_WORDS, CHUNK_OVERLAP = 150, 50

"""Character classes and patterns, written so that Java and RE2 read them alike."""

# Code point ranges that results depend on.
# Latin-1 members of WS stand one by one: Java tests those in one bit set, ranges one after the other.
WS = r"\t\n\x{0b}\f\r\x{1c}\x{1d}\x{1e}\x{1f}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The characters of WS.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
HANGUL = r"\x{AC00}-\x{D7A3}"
JAMO = r"\x{3130}-\x{318F}"
KOREAN = HANGUL + JAMO
LETTERS = r"\x{1100}-\x{11FF}"
SERVED = (
    r"\x{0020}-\x{007E}\x{00A0}-\x{00FF}\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{3040}-\x{309F}\x{30A0}-\x{30FF}"
    r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}"
)
NOISE = (
    r"\x{4000}-\x{4FFF}\x{8000}-\x{803F}\x{8800}-\x{883F}\x{8900}-\x{893F}\x{0400}-\x{04FF}\x{0100}-\x{017F}\x{0180}-\x{024F}"
    r"\x{0840}-\x{085F}\x{0900}-\x{097F}\x{E000}-\x{F8FF}\x{0000}-\x{001F}\x{007F}-\x{009F}\x{FFF0}-\x{FFFF}"
    r"\x{8D00}-\x{8D3F}\x{8C00}-\x{8C3F}\x{6340}-\x{637F}\x{52C0}-\x{52FF}"
)
ALLOWED = (
    r"\x{0020}-\x{007E}\x{00A0}-\x{00FF}\x{2000}-\x{206F}\x{2190}-\x{21FF}\x{2200}-\x{22FF}\x{2460}-\x{24FF}"
    r"\x{3000}-\x{303F}\x{3130}-\x{318F}\x{AC00}-\x{D7A3}\x{FF01}-\x{FF5E}"
)
ALLOWED_SPACES = r"\n\r\t"
ZERO_WIDTH = r"\x{200B}\x{200C}\x{200D}\x{FEFF}"
CONTROLS = r"\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}"
SPECIALS = r"\x{FFF0}-\x{FFFF}"
ROMAN_UPPER = r"\x{2160}-\x{216B}"
ROMAN_LOWER = r"\x{2170}-\x{2179}"
BULLETS = r"•·▪▫◦‣⁃\-*"
PDF_BULLETS = r"\p{Nd}\-•·▪▫◦‣⁃"

# Deletions of ASCII noise, in order. The first needs a back reference, which RE2 has not.
REPEATED = r"(?d)(.)\1{3,}"
ASCII_NOISE = (
    r"[A-Z]{8,}",
    r"[a-z]{10,}",
    r"[A-Za-z]{15,}",
    r"""[#$%&*+\-=<>?!@'"]{3,}""",
    r"[0-9#$%&*+\-=]{10,}",
    r"[()\[\]{}]{3,}",
    r"[,.]{3,}",
    r"""[A-Za-z0-9#$%&*+\-=<>?!@'"(){}\[\],.;:]{30,}""",
)

# Paragraph patterns.
HEADINGS = (
    rf"^제[{WS}]*\p{{Nd}}+[{WS}]*[장절조항]",
    rf"^\p{{Nd}}+\.[{WS}]+",
    rf"^[{HANGUL}]\.[{WS}]+",
    rf"^Chapter[{WS}]+\p{{Nd}}+",
    rf"^Section[{WS}]+\p{{Nd}}+",
    rf"^<[{ROMAN_UPPER}{ROMAN_LOWER}]+>",
    rf"^[{ROMAN_UPPER}{ROMAN_LOWER}]+\.",
    rf"^[{ROMAN_UPPER}{ROMAN_LOWER}]+[{WS}]+",
)
#: Level by the first pattern that the unstripped text begins with.
LEVELS = (
    (rf"^제[{WS}]*\p{{Nd}}+[{WS}]*장", 1),
    (rf"^제[{WS}]*\p{{Nd}}+[{WS}]*절", 2),
    (rf"^<[{ROMAN_UPPER}]+>", 1),
    (rf"^[{ROMAN_UPPER}]+\.", 1),
    (rf"^<[{ROMAN_LOWER}]+>", 2),
    (rf"^\p{{Nd}}+\.[{WS}]+", 2),
    (rf"^[{HANGUL}]\.[{WS}]+", 3),
)
DEFAULT_LEVEL = 2
BULLET_ITEM = rf"^[{WS}]*[{BULLETS}][{WS}]+"
NUMBER_ITEM = rf"^[{WS}]*\p{{Nd}}+[.)][{WS}]+"
KOREAN_ITEM = rf"^[{WS}]*[{HANGUL}][.)][{WS}]+"
LIST_PREFIX = rf"^[{WS}]*[{BULLETS}][{WS}]*|^[{WS}]*\p{{Nd}}+[.)][{WS}]*|^[{WS}]*[{HANGUL}][.)][{WS}]*"
TAGS = (
    ("date", rf"\p{{Nd}}{{4}}[-/년][{WS}]*\p{{Nd}}{{1,2}}[-/월][{WS}]*\p{{Nd}}{{1,2}}"),
    ("email", r"[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+"),
    ("url", rf"https?://[^{WS}]+"),
    ("phone", r"\p{Nd}{2,3}-\p{Nd}{3,4}-\p{Nd}{4}"),
    ("currency", rf"[₩$¥€£][{WS}]*[\p{{Nd}},]+"),
)

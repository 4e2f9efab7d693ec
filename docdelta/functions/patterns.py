"""Fixed values of the comparison semantics, in the JVM's regex dialect."""

# Character classes: a word character, white space, and white space but the line feed.
W = r"[\p{L}\p{N}_]"
S = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NS = r"[^\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
IN_LINE = r"[[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]&&[^\n]]"
# The signs of S themselves.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
LINE_BREAKS = r"\r\n|[\n\x{0b}\x{0c}\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
# Code points outside these ranges may not be in composed form.
MAYBE_DECOMPOSED = r"[^\x{0}-\x{2ff}\x{400}-\x{482}\x{48a}-\x{52f}\x{2010}-\x{2027}\x{20a0}-\x{20bf}\x{2116}\x{25a0}-\x{25ff}]"

SOFT_HYPHEN = "­"
# Dashes that count as a hyphen.
DASHES = "‐‑‒–—−"
LIST_ITEM = rf"^{S}*(?:[•*–—-]|\p{{Nd}}+[.)]|[A-Za-zА-Яа-яЁё][.)]){S}+{NS}"
NUMBERED_HEADING = rf"^\p{{Nd}}+(?:\.\p{{Nd}}+)*\.?{S}+{NS}"
SENTENCE_END = r"[.!?…;:]$"
PREFIX = rf"^{S}*(?:#{{1,6}}{S}+|[•▪◦‣*–—-]{S}+|\p{{Nd}}+(?:\.\p{{Nd}}+)*[.)]{S}+|[A-Za-zА-Яа-яЁё][.)]{S}+)"
LEADING_EMPHASIS = rf"^{S}*(?:\*\*|__|\*)+"
TRAILING_EMPHASIS = rf"(?:\*\*|__|\*)+{S}*$"
TOKEN = rf"{W}+|[^\p{{L}}\p{{N}}_\s\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]"
NUMBERING = rf"{S}*\p{{Nd}}+(?:\.\p{{Nd}}+)*[.)]{S}*"
LIST_MARKER = rf"{S}*[•▪◦‣*–—-]{S}*"
MARKDOWN = rf"{S}*(?:#{{1,6}}|\*+|_+|`+){S}*"
# A border between a word character and none, as Unicode sees it.
BORDER = rf"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"
DATE = rf"{BORDER}(?:\p{{Nd}}{{1,2}}[./-]\p{{Nd}}{{1,2}}[./-]\p{{Nd}}{{2,4}}|\p{{Nd}}{{4}}[./-]\p{{Nd}}{{1,2}}[./-]\p{{Nd}}{{1,2}}){BORDER}"
AMOUNT = rf"(?iu){BORDER}\p{{Nd}}[\p{{Nd}}\s\x{{a0}}\x{{2000}}-\x{{200a}}\x{{202f}}]*(?:[.,]\p{{Nd}}+)?{S}*(?:₽|руб(?:\.|лей)?|коп(?:\.|еек)?|USD|EUR){BORDER}"
ABBREVIATION = rf"(?<!{W})[A-ZА-ЯЁ]{{2,8}}(?!{W})"
PLAIN_WORD = r"[A-Za-zА-Яа-яЁё]+"

CATEGORIES = ("substantive", "technical", "alignment_error", "ocr_uncertain")
TECHNICAL_TYPES = ("markdown", "numbering", "page_number", "list_marker", "header_footer", "dash", "line_wrap")
BLOCK_CAP = 4000

"""Plain-Python restatement of the cleaning and splitting rules, used as
a brute-force model for the Spark expressions in tests."""

import re
import unicodedata
from html.parser import HTMLParser

SKIP = {"script", "style", "template"}


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in SKIP:
            self.skip += 1

    def handle_endtag(self, tag):
        if tag in SKIP and self.skip:
            self.skip -= 1

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def get_text(html: str) -> str:
    p = _Text()
    p.feed(html)
    p.close()
    return "".join(p.parts)


EMOJI_RANGES = [
    (0xA9, 0xA9), (0xAE, 0xAE), (0x203C, 0x203C), (0x2049, 0x2049), (0x2122, 0x2122), (0x2139, 0x2139),
    (0x2194, 0x2199), (0x21A9, 0x21AA), (0x231A, 0x231B), (0x2328, 0x2328), (0x23CF, 0x23CF),
    (0x23E9, 0x23F3), (0x23F8, 0x23FA), (0x24C2, 0x24C2), (0x25AA, 0x25AB), (0x25B6, 0x25B6),
    (0x25C0, 0x25C0), (0x25FB, 0x25FE), (0x2600, 0x27BF), (0x2934, 0x2935), (0x2B05, 0x2B07),
    (0x2B1B, 0x2B1C), (0x2B50, 0x2B50), (0x2B55, 0x2B55), (0x3030, 0x3030), (0x303D, 0x303D),
    (0x3297, 0x3297), (0x3299, 0x3299), (0x1F000, 0x1FAFF), (0x200D, 0x200D), (0x20E3, 0x20E3),
    (0xFE0E, 0xFE0F), (0xE0020, 0xE007F),
]


def _is_emoji(ch):
    o = ord(ch)
    return any(a <= o <= b for a, b in EMOJI_RANGES)


def strip_emoji(text: str) -> str:
    text = re.sub("[0-9#*][︎️]?⃣", "", text)
    return "".join(ch for ch in text if not _is_emoji(ch))


def _word_like(ch):
    return ch == "_" or unicodedata.category(ch)[0] in "LN"


def _url_at(text, i):
    """Length of the web address that begins here, 0 if none does."""
    for begin in ("http://", "https://", "www."):
        if text.startswith(begin, i):
            end = i + len(begin)
            while end < len(text) and not text[end].isspace():
                end += 1
            if end > i + len(begin):
                return end - i
    return 0


def clean_text(text):
    """One pass over the characters for addresses, one for what may stay."""
    if not isinstance(text, str):
        return ""
    if "<" in text or "&" in text:
        text = get_text(text)
    rest, i = [], 0
    while i < len(text):
        skip = _url_at(text, i)
        if not skip:
            rest.append(text[i])
        i += skip or 1
    kept, gap = [], False
    for ch in strip_emoji("".join(rest)):
        if ch.isspace():
            if not gap:
                kept.append(" ")
            gap = True
            continue
        gap = False
        if _word_like(ch) or ch in ".,!?:;-()":
            kept.append(ch)
    return "".join(kept).strip()


ABBREV = {"z.B", "d.h", "u.a", "usw", "bzw", "ca", "Dr", "Prof", "Nr", "Mio", "Mrd"}


def _protected(text: str, dot: int) -> bool:
    """Is the period at ``dot`` the end of an abbreviation, a single letter
    or a 1-2 digit number that starts at the beginning, a blank or '('?"""
    start = dot
    while start > 0 and text[start - 1] not in " (":
        start -= 1
    token = text[start:dot]
    if token in ABBREV:
        return True
    if len(token) == 1 and token.isalpha():
        return True
    return token.isdigit() and len(token) <= 2 and token.isascii()


def split_sentences(text: str) -> list:
    if not text:
        return []
    out, begin = [], 0
    for m in re.finditer(r"[.!?]+\)* +", text):
        punct = m.group(0).rstrip(" ")
        if punct == "." and _protected(text, m.start()):
            continue
        out.append(text[begin:m.start() + len(punct)])
        begin = m.end()
    out.append(text[begin:])
    return [s for s in out if s]

"""White space, spelled out so that every engine and regex dialect agrees on it."""

from __future__ import annotations

# The code points with the Unicode White_Space property.
WHITE_SPACE = (
    (0x09, 0x0D),
    (0x20, 0x20),
    (0x85, 0x85),
    (0xA0, 0xA0),
    (0x1680, 0x1680),
    (0x2000, 0x200A),
    (0x2028, 0x2029),
    (0x202F, 0x202F),
    (0x205F, 0x205F),
    (0x3000, 0x3000),
)

# Browsers count the byte order mark and leave out U+0085; one-line previews follow them.
PREVIEW_SPACE = tuple(span for span in WHITE_SPACE if span != (0x85, 0x85)) + ((0xFEFF, 0xFEFF),)


def characters(spans: tuple[tuple[int, int], ...]) -> str:
    return "".join(chr(point) for low, high in spans for point in range(low, high + 1))


def char_class(spans: tuple[tuple[int, int], ...]) -> str:
    """The inside of a regex character class, in a form Java and RE2 both read."""
    return "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in spans)


BLANKS = characters(WHITE_SPACE)
BLANK_CLASS = char_class(WHITE_SPACE)

"""The author's own text of a post: without quoted posts, code and signature."""

from __future__ import annotations

import html
import re

_QUOTE = re.compile(r"\[(/?)(quote)(?:=[^\]\n]*)?\]|<(/?)(blockquote)\b[^>\n]*>", re.I)
_QUOTED_LINE = re.compile(r"^[ \t]*(?:>|&gt;).*$", re.M)
_SAYING = "wrote", "schrieb", "escribió", "a écrit"
_RULES = "--", "* * *", "~~~", "____", "==="
_SAYS = re.compile(r"^.+(?:wrote|schrieb|escribió|a écrit) ?:[ \t]*$", re.M)
_CODE = re.compile(r"```.*?(?:```|\Z)|\[code\].*?(?:\[/code\]|\Z)|<pre\b[^>]*>.*?(?:</pre>|\Z)|<code\b[^>]*>.*?(?:</code>|\Z)", re.S | re.I)
SIGNATURE_LINES = 3  # what follows a line of dashes up to the end is a signature if it has no more lines; else it is a part of the post
_SIGNATURE = re.compile(r"(?:\A|\n)[ \t]*(?:--|\* \* \*|~~~|_{4,}|-{3,}|={3,})[ \t]*\n(?:[^\n]*(?:\n|\Z)){1,%d}\s*\Z|\[size=1\][^\n]*\[/size\]\s*\Z" % SIGNATURE_LINES)
_MARKUP = re.compile(r"</?(?:b|i|u|em|strong|span|font|p|div|a|small|sub|sup)(?:\s[^<>\n]*)?>|\[/?(?:b|i|u|s|color|size|url|font|left|center|right)(?:=[^\]\n]*)?\]|\*\*", re.I)
_BREAK = re.compile(r"<br ?/?>", re.I)


def _cut_quotes(text: str) -> str:
    """Quotes are nested and may be cut anywhere, so opening tags may lack an end.

    A closing tag ends the innermost open quote of its kind and all within. If
    that leaves a quote open, nested tags of one kind were cut: then the first
    closing tag ends all of its kind.
    """
    tags = [(m.start(), m.end(), (m[2] or m[4]).lower(), bool(m[1] or m[3])) for m in _QUOTE.finditer(text)]
    if not tags:
        return text
    for nested in (True, False):
        stack: list[tuple[str, int]] = []
        cuts: list[tuple[int, int]] = []
        for start, end, kind, closes in tags:
            kinds = [k for k, _ in stack]
            if not closes:
                stack.append((kind, start))
            elif kind in kinds:
                at = len(kinds) - 1 - kinds[::-1].index(kind) if nested else kinds.index(kind)
                begin = stack[at][1]
                del stack[at:]
                if not stack:
                    cuts.append((begin, end))
        if not stack:
            break
    if stack:  # never closed: up to the end of its paragraph
        end = text.find("\n\n", stack[0][1])
        cuts.append((stack[0][1], end if end >= 0 else len(text)))
    out, at = [], 0
    for a, b in cuts:
        out.append(text[at:a])
        at = max(at, b)
    return "\n\n".join([*out, text[at:]])


def own_text(text: str | None) -> str:
    """What is left of a post without quoted posts, code and signature, and without markup."""
    if not text:
        return ""
    t, tagged = text, "<" in text
    if tagged:
        t = _BREAK.sub("\n", t)
    if ">" in t or "&gt;" in t:
        t = _QUOTED_LINE.sub("", t)
    tagged = "<" in t or "[" in t
    if tagged:
        t = _cut_quotes(t)
    if tagged or "```" in t:
        t = _CODE.sub("\n\n", t)
    if any(w in t for w in _SAYING):
        t = _SAYS.sub("", t)
    if tagged or any(w in t for w in _RULES):
        t = _SIGNATURE.sub("", t)
    if tagged or "**" in t:
        t = _MARKUP.sub("", t)
    return html.unescape(t).strip() if "&" in t else t.strip()

"""Pattern dialects.

Catalogue patterns are written once, with Unicode-aware ``\\w``, ``\\s``, ``\\d``
and ``\\b``, ``.`` stopping at newline only, and ``$`` before a final newline.
``java`` spells the same pattern for Spark, ``re2`` for the SQL oracle.
"""

from __future__ import annotations

import re

from leafmill.functions import catalog as C

WORD = r"\p{L}\p{N}_"
_SPACE_JAVA = r"\s\x1C-\x1F\x{85}\p{Z}"
_SPACE_RE2 = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"
_TOKEN = re.compile(r"\\.|\[\^?|\]|[^\\\[\]]+", re.S)

# every character that counts as white space when stripping
WHITESPACE = "".join(chr(c) for c in [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                                      *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def _spell(pattern: str, space: str) -> str:
    classes = {"w": WORD, "s": space, "d": r"\p{Nd}"}
    out, inside = [], False
    for token in _TOKEN.findall(pattern):
        if token in ("[", "[^"):
            inside = True
            out.append(token)
        elif token == "]":
            inside = False
            out.append(token)
        elif token[0] == "\\" and token[1] in classes:
            body = classes[token[1]]
            out.append(body if inside else f"[{body}]")
        elif token == r"\S":
            out.append(f"[^{space}]")
        elif token == "\\•":
            out.append("•")
        else:
            out.append(token)
    return "".join(out)


# Spellings with the same matches whose time and stack use do not grow with the text.  A repeated
# group recurses once per repetition in Java unless it is possessive, and a pattern that starts
# with a run retries at every position of the run; a start inside a run is allowed only
# right behind the previous match (\G).


def alternatives(pattern: str) -> str:
    """The last plain group of alternatives in a pattern, with its brackets; '' without one."""
    groups = [g for g in re.findall(r"\(\?:[^()]*\)(?![?*])", pattern) if "|" in g]
    return groups[-1] if groups else ""


def _steady() -> dict[str, str]:
    company, maker = C.ENTITY_PATTERNS["organization"]
    amount, mail = C.ENTITY_PATTERNS["money"][1], C.ENTITY_PATTERNS["email"][0]
    form, name = C.DOCUMENT_RULES["form"][2][3], C.QUESTION_PATTERNS["name"]
    ends = alternatives(company)
    return {
        company: rf"(?:\G|(?<![A-Z][a-z]{{1,40}}\s{{1,20}}))[A-Z][a-z]+(?:\s+(?!{ends})[A-Z][a-z]+)*+\s+{ends}",
        maker: r"(?:\G|(?<![A-Z]))[A-Z]{2,}+\s+" + alternatives(maker),
        amount: r"(?:\G|(?<![\d,]))[\d,]++(?:\.\d*+)?+\s*+" + alternatives(amount),
        mail: r"(?:\G|(?<![a-zA-Z0-9._%+-]))[a-zA-Z0-9._%+-]++" + mail[mail.index("@"):],
        name: name.replace("*)", "*+)"),
        form: r"(?<!_)_++\s*+" + form[form.index(r"\("):],
        C.BULLET_PATTERN: r"(?:^|(?:\G|(?<!\n))\n)\s*+" + C.BULLET_PATTERN[C.BULLET_PATTERN.index(r"\s*") + 3:].replace(r"\d+", r"\d++"),
    }


STEADY = _steady()

#: The one of them among the type rules, for ``re``.
STEADY_PYTHON = {C.DOCUMENT_RULES["form"][2][3]: STEADY[C.DOCUMENT_RULES["form"][2][3]]}


def java(pattern: str, ignore_case: bool = False, multiline: bool = False, dotall: bool = False) -> str:
    """Java spelling; a leading/trailing ``\\b`` next to a word character becomes a look-around."""
    body = STEADY.get(pattern, pattern)
    head = tail = ""
    if body.startswith(r"\b"):
        head, body = rf"(?<![{WORD}])", body[2:]
        if first := re.match(r"\[[^\]^][^\]]*\]", body):  # tested before what stands in front, as it mostly fails
            head = f"(?={first.group()}){head}"
    if body.endswith(r"\b"):
        tail, body = rf"(?![{WORD}])", body[:-2]
    flags = "d" + ("iu" if ignore_case else "") + ("m" if multiline else "") + ("s" if dotall else "")
    return f"(?{flags}){head}{_spell(body, _SPACE_JAVA)}{tail}"


def re2(pattern: str, ignore_case: bool = False, multiline: bool = False, dotall: bool = False) -> str:
    """RE2 spelling used in oracle SQL (its ``\\b`` only knows ASCII words)."""
    on = ("i" if ignore_case else "") + ("m" if multiline else "") + ("s" if dotall else "")
    off = "" if dotall else "-s"
    return f"(?{on}{off}){_spell(pattern, _SPACE_RE2)}"


def folded(pattern: str, dotted: bool = False) -> str:
    """Spelling of a case-insensitive pattern for text that is folded to lower case; ``re`` searches it faster, as it
    can look for the first literal.  ``dotted``: the text keeps its capital i with a dot, which equals an i by itself and
    in a range of small letters."""
    out, inside = [], False
    for token in _TOKEN.findall(pattern):
        inside = token in ("[", "[^") or inside and token != "]"
        low = token if token[0] == "\\" else token.lower()
        if dotted and token[0] != "\\":
            low = low + "İ" * ("a-z" in token) if inside else low.replace("i", "[iİ]")
        out.append(low)
    return "".join(out)


def _longest_run(pattern: str) -> str:
    """Longest plain run outside groups, classes and optional items."""
    if re.fullmatch(r"[\w #-]+", pattern):
        return pattern
    bare = re.sub(r"\\.|\[[^\]]*\]", "~", pattern)
    while (inner := re.sub(r"\([^()]*\)", "~", bare)) != bare:
        bare = inner
    bare = re.sub(r".(?:[?*]|\{[^}]*\})", "~", bare)
    return "" if "|" in bare else max(re.findall(r"[\w ]+", bare), key=len, default="").strip()


def needed_literals(pattern: str) -> list[str]:
    """Lower-case literals of which every match contains at least one; [] when there is no such list.

    Taken from the arms of a leading alternation, else from the longest plain run.
    """
    lead = re.match(r"(?:\\b)?\(\?:([^()]*)\)(?![?*])", pattern)
    parts = lead.group(1).split("|") if lead else [pattern]
    runs = [_longest_run(part).lower() for part in parts]
    return list(dict.fromkeys(runs)) if all(runs) else []

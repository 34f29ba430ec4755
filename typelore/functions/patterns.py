"""Patterns, letters and word lists that decide results.

All patterns are written for Java's regular expressions. Unicode classes are spelled out, so that letters, digits and
blanks outside ASCII count as such without the slower ``(?U)`` mode.
"""

from __future__ import annotations

# ---- Fixed values: type codes and declarations --------------------------------------------------------------------

TYPE = "[IEX][SNX][FTX][JPX]"

# name, pattern, number of the group that holds the type; the order decides which match counts as the last one
DECLARATIONS = (
    ("i_am_mbti_regex", f"I('m| am)(?: (an|a))? ({TYPE})", 3),
    ("my_mbti_regex", f"(M|m)y ({TYPE}) (personality|experience)", 2),
    ("mbti_here_regex", rf"({TYPE})(?: \((m|f)\))? here", 1),
    ("fellow_mbti_regex", f"(F|f)ellow ({TYPE})", 2),
    ("i_mbti_regex", rf"(Me|I)(?: )?\(({TYPE})\)", 2),
    ("looking_for_regex", f"({TYPE}) looking for", 1),
)

# mathematical bold capitals, U+1D400 to U+1D419
BOLD_CAPITALS = "".join(chr(0x1D400 + i) for i in range(26))
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# flag column, letter for 1, letter for 0, position in the type code
DICHOTOMIES = (
    ("is_E", "E", "I", 1),
    ("is_S", "S", "N", 2),
    ("is_T", "T", "F", 3),
    ("is_J", "J", "P", 4),
)

# ---- Fixed values: text patterns ----------------------------------------------------------------------------------

WORD_CHAR = r"\p{L}\p{N}"
BLANK_CHAR = r"\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

POST_DELIMITER = "|||"

URL = (
    r"https?://(www\.)?[-a-zA-Z0-9@:%._+~#=]{2,256}\.[a-z]{2,4}"
    rf"(?![{WORD_CHAR}_])([-a-zA-Z0-9@:%_+.~#?&/=]*)"
)

PUNCTUATION = r"[.!?\\-]"
PUNCTUATION_CHARS = ".!?\\-"

EMOJI_END = rf"(?=[{BLANK_CHAR}]|[!.?]|$)"

# forms of an emoji: the characters it may begin with, and what follows
EMOJI_FORMS = {
    # what the counted pattern really matches
    "effective": (
        (":", rf"[{WORD_CHAR}_]+:"),
        ("<", r"[/\]?3|\[()\\D*$][-^]?[:;=]"),
        (":;=B8", r"[-^]?[3DOPp@$*\\)(/|]"),
    ),
    # what its description promises: hearts and mirrored faces as well
    "documented": (
        (":", rf"[{WORD_CHAR}_]+:"),
        ("<", r"[/\\]?3"),
        (r"()\\|*$", r"[-^]?[:;=]"),
        (":;=B8", r"[-^]?[3DOPp@$*\\)(/|]"),
    ),
}

# ---- end of fixed values ----------------------------------------------------------------------------------------


def _emoji(forms: tuple[tuple[str, str], ...]) -> str:
    """Any of the forms. The first character is read before the form is chosen, which settles most positions at once."""
    first = "".join(dict.fromkeys("".join(start for start, _ in forms).replace(r"\\", "\\"))).replace("\\", r"\\")
    rest = "|".join(f"(?<=[{start}]){follows}" for start, follows in forms)
    return f"[{first}](?:{rest}){EMOJI_END}"


EMOJI = {mode: _emoji(forms) for mode, forms in EMOJI_FORMS.items()}

# ---- Fixed values: tokenizer --------------------------------------------------------------------------------------

# contractions that the word tokenizer splits in two
CONTRACTIONS = (
    ("can", "not"),
    ("gim", "me"),
    ("gon", "na"),
    ("got", "ta"),
    ("lem", "me"),
    ("wan", "na"),
)

# ---- Fixed values: English stopwords ------------------------------------------------------------------------------

STOPWORDS = tuple(
    """
    i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his
    himself she she's her hers herself it it's its itself they them their theirs themselves what which who whom this
    that that'll these those am is are was were be been being have has had having do does did doing a an the and but
    if or because as until while of at by for with about against between into through during before after above below
    to from up down in out on off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very s t can will just don don't should
    should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't
    haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't
    weren weren't won won't wouldn wouldn't
    """.split()
)

# ---- Fixed values: noun endings and their replacements, in the order they are tried ---------------------------------

NOUN_ENDINGS = (
    ("s", ""),
    ("ses", "s"),
    ("ves", "f"),
    ("xes", "x"),
    ("zes", "z"),
    ("ches", "ch"),
    ("shes", "sh"),
    ("men", "man"),
    ("ies", "y"),
)

# ---- Fixed values: what a comment is tidied of ----------------------------------------------------------------------

QUOTED_LINE = r"(?m)^[ \t]*(?:>|&gt;)[^\n]*(?:\n|\z)"
VIEW_POLL = r"\[View Poll\](?:\([^)\s]*\))?"
ABBREVIATIONS = {"bc": "because"}

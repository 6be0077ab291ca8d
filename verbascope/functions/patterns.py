"""Character classes and patterns for Java regular expressions that agree with Unicode text conventions.

\\w, \\s and \\b of Java regexes are ASCII or differ between versions, so every class is spelled out.
"""

import re

WS = r"\t-\r\x1c-\x20\x85\xa0  -     　"
#: White space that stays on its line.
WS_IN_LINE = r"\t\x0b-\r\x1c-\x20\x85\xa0  -     　"
#: A character of white space and one of anything else. Classes are tried from the left, so the first part settles nearly all characters.
SP, NS = rf"[[^!-~]&&[{WS}]]", rf"[!-~[^{WS}]]"
#: A class of single characters is one table, which is looked up first; ranges are tried one after another.
_ASCII_WORD = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"
W = rf"[[{_ASCII_WORD}][\p{{L}}\p{{N}}]]"
#: A character that is neither white space nor a word character.
SIGN = rf"[[^{_ASCII_WORD} ]&&[^\p{{L}}\p{{N}}]&&[^{WS}]]"
#: Word boundaries before and after a word character.
BEFORE, AFTER = rf"(?<!{W})", rf"(?!{W})"


def any_literal(words) -> str:
    """An alternation of literals by common beginnings, so that a text fails it at its first characters; of two that begin alike, the longer one matches."""

    def part(rest: list[str]) -> str:
        firsts = sorted({w[0] for w in rest if w})
        found = [re.sub(r"([^\w\s])", r"\\\1", c) + part([w[1:] for w in rest if w and w[0] == c]) for c in firsts]
        if not found:
            return ""
        whole = found[0] if len(found) == 1 and "" not in rest else f"(?:{'|'.join(found)})"
        return f"{whole}?" if "" in rest else whole

    return part(sorted(set(words)))


def any_of(words, flags: str = "(?iu)") -> str:
    return f"{flags}{BEFORE}{any_literal(words)}{AFTER}"


# The patterns that results depend on.
SENTENCE_END = rf"[.!?][\"'”’)\]]*(?:{SP}+|\z)"
BULLET = rf"^{SP}*(?:[-*]{SP}|\p{{Nd}}+[.)]{SP})"
BOLD_BULLET = rf"^{SP}*(?:[-*]|\p{{Nd}}+[.)]){SP}+\*\*"
BOLD_HEADER = rf"\*\*[^*]+[.:]\*\*{SP}+{NS}"
TRIAD = rf"{W}++, {W}++, (?iu:and) {W}+"
NOT_JUST_BUT = r"(?diu)not (?:just|only) .{1,40}, but (?:also )?"
OPENER = rf"(?dimu)(?:^|[.!?]{SP}+)%s[,! ]"
CUTOFF = rf"(?iu){BEFORE}as of my (?:last |knowledge )?cutoff{AFTER}"
JUST_AI = rf"(?iu){BEFORE}i'm just an? ai{AFTER}"
PLACEHOLDER = r"(?iu)\[insert [^\]]*\]|\[describe [^\]]*\]|\[url [^\]]*\]|\[your [^\]]*\]|\[todo[^\]]*\]"
X_NOT_Y = rf"{BEFORE}{W}++, not {W}+"
STAGED = rf"(?iu){BEFORE}not (?:only|just|merely){AFTER}[^.!?\n]{{1,80}}?{BEFORE}but(?: also)?{AFTER}[^.!?\n,;:]{{1,80}}?(?=[,.;:!?]|\n|\z)"
_RESOLUTION = rf"[.;:,]{SP}*(?:it's|they're|that's|he's|she's|we're|it{SP}+is|they{SP}+are|that{SP}+is|this{SP}+is|these{SP}+are|those{SP}+are|%swhat's|what{SP}+is|the{SP}+real|the{SP}+actual|instead|rather)"
_NEGATED = "|".join([*(f"{v}n't" for v in "is are was were does do did has have wo ca could should".split()), *(rf"{v}{SP}+not" for v in "is are was were does do did has have will could should".split()), "cannot"])
SETUP_A = rf"(?diu){BEFORE}(?:this|that|these|those|it|they|we){SP}+(?:{_NEGATED}){AFTER}.{{0,80}}" + _RESOLUTION % rf"he{SP}+is|she{SP}+is|we{SP}+are|"
SETUP_B = rf"(?diu){BEFORE}(?:it's|that's|this{SP}+is|they're|he's|she's|we're){SP}+not{AFTER}.{{0,80}}" + _RESOLUTION % ""
PIVOT = rf"(?iu),{SP}+(?:but|yet|and|not|or){AFTER}"
COLON = r"(?<!http)(?<!https): (?!true|false|null)[a-z]"
DIVIDER = rf"(?dm)^{SP}*(?:---+|\*\*\*+|___+){SP}*$"
DASH = r"—| -- "
COPULA = any_of(("is", "are", "was", "were"))
BOLD_SPAN = r"\*\*[^*\n]+?\*\*"
NUMERIC_BOLD = rf"^[{WS}$%€£¥+\-.,]*\p{{Nd}}[{WS}\p{{Nd}}.,$%€£¥+\-]*[%a-zA-Z]{{0,4}}\n?\z"
APHORISMS = (
    rf"(?diu)^sometimes{AFTER}",
    rf"(?diu){BEFORE}isn't{AFTER}.{{1,40}}{BEFORE}it's{AFTER}",
    rf"(?diu){BEFORE}not{AFTER}.{{1,30}}{BEFORE}it's{AFTER}.{{1,40}}$",
    rf"(?diu)^the (?:real|true|actual|biggest|greatest|most important){AFTER}",
    rf"(?diu)^(?:in the end|ultimately|at the end of the day){AFTER}",
    rf"(?diu){BEFORE}we (?:bring|carry|create|make|build|choose){AFTER}",
    r"(?diu)^that's (?:the |what |where |why |how )",
    rf"(?diu)^it (?:all )?(?:comes|boils) down to{AFTER}",
)
TITLE_TOKEN = r"[A-Z][a-z]+(?:['-][A-Z][a-z]+)*"

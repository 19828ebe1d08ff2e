"""Column expressions over text.

The patterns spell out Python's Unicode reading of white space and word
characters, since Java's differs. None repeats a group: Java recurses there, and
a long text would exhaust the stack.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python's \s and \w match, as members of a class.
_SPACES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTERS = r"\p{L}\p{N}_"

_WS = f"[{_SPACES}]"
_SPACE_CHARS = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]))

# Dialogue is read off runs: from a capital that begins a word to the last of the
# capitals, white space and hyphens that follow. The possessive "++" takes a run whole
# and never gives it back, so no run is read again from its middle.
_IN_RUN = rf"[A-Z{_SPACES}\-]"
_RUN_START = rf"[A-Z](?<![{_LETTERS}][A-Z])"  # the cheap test first
_RUN = rf"{_RUN_START}{_IN_RUN}++"
_ASIDE = rf"\(.*?\)(?={_WS})"
# A run cues a speaker if white space follows a capital past its first. The first cue of a
# script needs less: white space past its second character, or an aside.
_OPENING = rf"{_RUN_START}(?:(?={_IN_RUN}+{_WS}){_IN_RUN}++|{_IN_RUN}++(?=\())"
_CUE = rf"{_RUN_START}(?={_IN_RUN}*[A-Z]{_WS}){_IN_RUN}++"
_TURN = rf"{_CUE}(?:{_ASIDE})?"
_FIRST_TURN = rf"^[A-Z]{_IN_RUN}++(?:{_ASIDE})?"

# Stand for a "(" that opens no aside, for the places before and after a cue, and for
# these in the text itself; noncharacters, so real text hardly holds them.
_SHIELD, _MARK, _PASSED, _ESCAPE = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"
_ESCAPED = {_ESCAPE: "\ufdd4", _SHIELD: "\ufdd5", _MARK: "\ufdd6", _PASSED: "\ufdd7"}


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACE_CHARS))


def words(text: Column) -> Column:
    """Words between white space, without empty ones."""
    return F.filter(F.split(text, f"{_WS}+"), lambda word: word != "")


def tokens(text: Column) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{_LETTERS}]{{2,}}"), F.lit(0))


def truncate_words(text: Column, max_words: int) -> Column:
    """The first ``max_words`` words, joined by single spaces."""
    return F.array_join(F.slice(words(text), 1, max_words), " ")


def lexical_diversity(text: Column) -> Column:
    """Share of distinct words in one text, 4 digits; 0 for an empty text."""
    tokens = words(F.lower(text))
    share = F.try_divide(F.size(F.array_distinct(tokens)), F.size(tokens))
    return F.round(F.coalesce(share, F.lit(0.0)), 4)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out a single time per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def upper_cue_lines(text: Column) -> Column:
    """Upper-case each run of plain letters, digits and spaces that ends a line."""
    cue = rf"(?md)^[a-zA-Z0-9{_SPACES}]+\n"

    def weave(script: Column) -> Column:
        woven = F.zip_with(
            F.split(script, cue, -1),
            F.regexp_extract_all(script, F.lit(cue), F.lit(0)),
            lambda plain, found: F.concat(plain, F.coalesce(F.upper(found), F.lit(""))),
        )
        return F.array_join(woven, "")

    return once(text, weave)


def clean_script(text: Column, max_chars: int | None = None) -> Column:
    """Squeeze white space and upper-case cue lines; whole text unless cut."""
    squeezed = F.regexp_replace(text, r"\n+", "\n")
    squeezed = F.regexp_replace(squeezed, f"{_WS}{{2,}}", " ")
    cleaned = upper_cue_lines(squeezed)
    return cleaned if max_chars is None else F.substring(cleaned, 1, max_chars)


def _escaped(text: Column) -> Column:
    """Text free of the marks used below; they are no letters, so words stay words."""
    free = text
    for mark, code in _ESCAPED.items():
        free = F.replace(free, F.lit(mark), F.lit(_ESCAPE + code))
    held = F.contains(text, F.lit(_ESCAPE))
    for mark in (_SHIELD, _MARK, _PASSED):
        held |= F.contains(text, F.lit(mark))
    return F.when(held, free).otherwise(text)


def _unescaped(text: Column) -> Column:
    plain = F.translate(text, _SHIELD, "(")
    for mark, code in reversed(_ESCAPED.items()):
        plain = F.replace(plain, F.lit(_ESCAPE + code), F.lit(mark))
    return plain


def _shield_unclosed(script: Column) -> Column:
    """Hide each "(" after the last ")" that white space follows: it opens no aside."""
    hidden = once(
        F.regexp_extract(script, rf"(?s)^(.*\){_WS})", 1),
        lambda head: F.concat(
            head, F.translate(F.substr(script, F.length(head) + 1), "(", _SHIELD)
        ),
    )
    return F.when(F.contains(script, F.lit("(")), hidden).otherwise(script)


def _marked(script: Column, cue: str) -> Column:
    """The script with a mark before each run that is a ``cue``; other runs are passed whole."""
    both = F.regexp_replace(script, f"(?s)({cue})|({_RUN})", f"{_MARK}$1{_PASSED}$2")
    return F.translate(F.replace(both, F.lit(_MARK + _PASSED), F.lit("")), _PASSED, "")


def _before(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def _from(text: Column, start: Column) -> Column:
    return F.substr(text, F.length(start) + 1)


def _with_opening(marked: Column) -> Column:
    """Mark the first cue too, where it comes before the first marked one."""

    def opened(head: Column) -> Column:
        # Most scripts begin with a cue like the others, so this text is short.
        placed = _marked(head, _OPENING)
        start = _before(placed, _MARK)
        rest = _from(marked, start)
        # Only an aside reaches over cues that are marked by now.
        again = _marked(F.translate(rest, _MARK, ""), f"{_FIRST_TURN}|{_TURN}")
        aside = F.regexp_like(rest, F.lit(rf"(?s)^[A-Z]{_IN_RUN}++\("))
        return (
            F.when(~F.contains(placed, F.lit(_MARK)), _from(marked, head))
            .when(aside, again)
            .otherwise(F.concat(F.lit(_MARK), rest))
        )

    return once(_before(marked, _MARK), opened)


def _speech(turn: Column) -> Column:
    """(character, line) of a text that begins with its cue."""
    name = rf"(?s)^[A-Z](?:{_IN_RUN}++(?=\()|{_IN_RUN}+(?={_WS}))"

    def parted(cue: Column) -> Column:
        said = _from(turn, cue)
        after = F.when(F.startswith(said, F.lit("(")), F.regexp_replace(said, f"(?s)^{_ASIDE}", "")).otherwise(said)
        line = _unescaped(F.translate(strip(after), "\n", " "))
        return F.struct(strip(cue).alias("character"), line.alias("line"))

    return once(F.regexp_extract(turn, name, 0), parted)


def dialogue_pairs(script: Column) -> Column:
    """Ordered array of (character, line) spoken in a script, in time linear in its length.

    Each run is a cue or not by what it holds, and a mark goes before each cue; what lies
    between two marks is one speech. An aside goes along with its cue, so runs inside it
    cue nobody.
    """
    shielded = once(_escaped(script), _shield_unclosed)
    marked = once(_marked(shielded, _TURN), _with_opening)
    turns = F.filter(F.split(marked, _MARK, -1), lambda turn: turn != "")
    return F.filter(F.transform(turns, _speech), lambda pair: pair["line"] != "")

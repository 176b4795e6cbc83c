"""Column -> Column text cleaning. Everything stays inside the JVM.

Flags: ``(?iU)`` is case-insensitive with Unicode classes, so ``\\s``, ``\\w``
and ``\\b`` treat accented letters as letters on every Java version.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from codexflow.functions import fixed_values as V
from codexflow.functions.arrays import empty, let

ColumnFn = Callable[[Column], Column]


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of any kind, newlines included."""
    return F.btrim(text, F.lit(V.STRIP_CHARS))


def sub(text: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    return F.regexp_replace(text, f"(?{flags}){pattern}" if flags else pattern, replacement)


def drop_all(text: Column, *patterns: str) -> Column:
    return reduce(lambda acc, p: sub(acc, p, "", "iU"), patterns, text)


def when_any(text: Column, needles: tuple[str, ...], then: ColumnFn, fold: bool = False) -> Column:
    """Apply ``then`` only where one of the literal needles occurs.

    A byte search costs far less than the regex it spares. The text is bound
    once, so chained rules do not multiply the expression.
    """
    def found(probe):
        return reduce(lambda a, b: a | b, [F.contains(probe, F.lit(n)) for n in needles])

    def body(t):
        return F.when(let(F.lower(t), found) if fold else found(t), then(t)).otherwise(t)

    return let(text, body)


def drop_rules(text: Column) -> Column:
    return when_any(text, ("____", "----"), lambda t: sub(t, V.NOISE_RULES, ""))


def drop_page_furniture(text: Column, *patterns: str) -> Column:
    """Headers, footers and ruled lines. Every footer pattern needs one of two words."""
    return drop_rules(when_any(text, ("departamento", "decreto"), lambda t: drop_all(t, *patterns), fold=True))


def first_match(text: Column, pattern: str, group: int, flags: str = "") -> Column:
    """First match of a group, NULL when there is none."""
    rx = f"(?{flags}){pattern}" if flags else pattern
    return not_empty(F.regexp_extract(text, rx, group))


def not_empty(value: Column) -> Column:
    """NULL for ''; the value is computed once."""
    return let(value, lambda v: F.when(v != "", v))


def first_of(text: Column, patterns: list[str], group: int, flags: str = "iU") -> Column:
    """First pattern that matches wins, first occurrence within it."""
    return F.coalesce(*[first_match(text, p, group, flags) for p in patterns])


# ---------------------------------------------------------------- profiles

def clean_general(text: Column) -> Column:
    return strip(sub(text, r"\s+", " ", "U"))


def dot_decimals(text: Column) -> Column:
    return sub(text, r"(\d+)\s*,\s*(\d+)", "$1.$2", "U")


def clean_ocr(text: Column) -> Column:
    """Lone l/I/1 and O/o become digits, decimal commas become dots."""
    text = sub(text, r"\b[lI1]\b", "1", "U")
    text = sub(text, r"\b[Oo]\b", "0", "U")
    return clean_general(dot_decimals(text))


def normalize_resolution_number(text: Column) -> Column:
    return sub(text, r"Resolución\s+No\.\s*0*", "Resolución No. ", "iU")


def inject_headings(text: Column, headings=tuple(V.SECTION_HEADINGS), compat: bool = False) -> Column:
    """Mark section openers as Markdown headings.

    Default: only at the start of a line, so prose and already marked headings
    are left alone. ``compat`` marks every occurrence.
    """
    def mark_all(t):
        for word, marks in headings:
            pattern, flags = (word, "iU") if compat else (rf"^{word}", "iUm")
            t = sub(t, pattern, f"{marks} {word}", flags)
        return t

    return when_any(text, tuple(w.lower() for w, _ in headings), mark_all, fold=True)


def strip_noise(text: Column, compat: bool = False) -> Column:
    decree = V.NOISE_DECREE_GREEDY if compat else V.NOISE_DECREE_LINE
    known = ("departamento", "decreto", "diario")
    patterns = (V.NOISE_AGENCY, decree, V.NOISE_GAZETTE)
    return drop_rules(when_any(text, known, lambda t: drop_all(t, *patterns), fold=True))


def normalize_units(text: Column, compat: bool = False) -> Column:
    for unit in ("m³", "L/s"):
        pattern, value = (r"(\d+)\.?(\d*)", "$1.$2") if compat else (r"(\d+(?:\.\d+)?)\.?", "$1")
        text = when_any(text, (unit,), _unit_rule(rf"{pattern}\s*{unit}", f"{value} {unit}"))
    return text


def _unit_rule(pattern: str, replacement: str) -> ColumnFn:
    return lambda t: sub(t, pattern, replacement, "U")


def collapse_blank(text: Column, newlines: str = "\n\n\n") -> Column:
    """Runs of four or more newlines shrink, runs of spaces become one."""
    text = when_any(text, ("\n\n\n\n",), lambda t: sub(t, r"\n{4,}", newlines))
    return strip(squeeze_spaces(text))


def squeeze_spaces(text: Column) -> Column:
    return when_any(text, ("  ",), lambda t: sub(t, r" {2,}", " "))


def clean_legal(text: Column, compat: bool = False) -> Column:
    """Default keeps line structure so that headings survive for the chunker.

    ``compat`` flattens the text through the OCR profile first, as the original
    behaviour does.
    """
    text = clean_ocr(text) if compat else squeeze_spaces(when_any(dot_decimals(text), ("\t",), lambda t: F.translate(t, "\t", " ")))
    text = when_any(text, ("resoluci",), normalize_resolution_number, fold=True)
    text = inject_headings(text, compat=compat)
    text = strip_noise(text, compat)
    return collapse_blank(normalize_units(text, compat))


def clean_contract(text: Column, compat: bool = False) -> Column:
    return inject_headings(clean_legal(text, compat), tuple(V.CONTRACT_HEADINGS), compat)


def _fold_tables() -> tuple[str, str]:
    """Accent table by rule: decompose, keep the base letter when it is ASCII."""
    table = dict(V.SINGLE_CHAR_FOLDS)
    for code in [*range(0xC0, 0x180), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFKD", chr(code))[0]
        if base.isascii() and base != chr(code):
            table.setdefault(chr(code), base)
    return "".join(table), "".join(table.values())


def fold_accents(text: Column) -> Column:
    src, dst = _fold_tables()
    for char, repl in V.MULTI_CHAR_FOLDS:
        text = F.replace(text, F.lit(char), F.lit(repl))
    return F.translate(text, src, dst)


PROFILES: dict[str, ColumnFn] = {
    "general": clean_general,
    "legal_colombia": clean_legal,
    "contract": clean_contract,
    "ocr_output": clean_ocr,
}
DEFAULT_PROFILE = "legal_colombia"


def register_profile(name: str, fn: ColumnFn) -> None:
    PROFILES[name] = fn


def clean(text: Column, profile: str = DEFAULT_PROFILE, remove_accents: bool = False) -> Column:
    """Apply one named profile; unknown names use the default, NULL becomes ''."""
    out = PROFILES.get(profile, PROFILES[DEFAULT_PROFILE])(F.coalesce(text, F.lit("")))
    return strip(fold_accents(out) if remove_accents else out)


def clean_by_profile(text: Column, profile: Column) -> Column:
    """Profile chosen per row."""
    expr = None
    for name, fn in PROFILES.items():
        if name != DEFAULT_PROFILE:
            cond, value = profile == name, strip(fn(F.coalesce(text, F.lit(""))))
            expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr.otherwise(clean(text))


# --------------------------------------------------------- source cleaners

def clean_loader(text: Column) -> Column:
    return collapse_blank(drop_page_furniture(text, V.NOISE_AGENCY, V.NOISE_DECREE_FOOTER))


def clean_markdown(text: Column) -> Column:
    return collapse_blank(drop_page_furniture(text, V.NOISE_DECREE_LOOSE, V.NOISE_AGENCY_LOOSE))


def clean_page(text: Column) -> Column:
    """Remove page furniture, then blank lines."""
    text = drop_page_furniture(F.coalesce(text, F.lit("")), V.NOISE_DECREE_LOOSE, V.NOISE_AGENCY_LOOSE)
    lines = F.filter(F.split(text, "\n"), lambda line: strip(line) != "")
    return strip(F.array_join(lines, "\n"))


def clean_basic(text: Column) -> Column:
    text = drop_page_furniture(text, V.NOISE_AGENCY, V.NOISE_DECREE_FOOTER)
    return collapse_blank(sub(text, V.NOISE_PAGE_MARK, "", "U"), "\n\n")


# ------------------------------------------------------------------ lines

def lines_to_markdown(text: Column) -> Column:
    """Plain page text to pseudo-Markdown, line by line."""
    lines = F.transform(F.split(text, "\n"), strip)
    kept = F.filter(lines, lambda x: (x != "") & ~F.rlike(x, F.lit(f"(?iU){V.NOISE_LINE}")))
    marked = F.transform(
        kept,
        lambda x: F.when(F.rlike(x, F.lit(f"(?iU){V.LEGAL_LINE_START}")), F.concat(F.lit("\n## "), x, F.lit("\n")))
        .when(F.rlike(x, F.lit(f"(?U){V.NUMERAL_LINE_START}")), F.concat(F.lit("- "), x))
        .otherwise(x),
    )
    return clean_markdown(F.array_join(marked, "\n"))


def rows_to_markdown_table(rows: Column) -> Column:
    """array<array<string>> to a Markdown table; first row is the header.

    NULL cells render empty; a table without rows or header cells gives NULL.
    """
    def render(row):
        cells = F.transform(row, lambda c: F.coalesce(c, F.lit("")))
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |\n"))

    def table(all_rows):
        header = F.get(all_rows, F.lit(0))
        rule = F.transform(header, lambda _: F.lit("---"))
        body = F.transform(all_rows, lambda row, i: F.when(i > 0, render(row)).otherwise(""))
        return F.when(F.size(header) > 0, F.concat(render(header), render(rule), F.array_join(body, "")))

    return let(rows, table)


def join_broken_paragraphs(text: Column) -> Column:
    """Join a paragraph that does not close with the one that continues it.

    A joined pair is consumed whole, so its second half never opens another
    join. The work grows with the number of paragraphs, not its square.
    """
    return let(F.transform(F.split(text, r"\n\n+"), strip), _join_paragraphs)


def _join_paragraphs(parts: Column) -> Column:
    def mark(p, i):
        nxt = F.get(parts, i + 1)
        # an empty paragraph has no last character, which counts as closed
        is_open = ~F.contains(F.lit(V.CLOSING_CHARS), F.right(p, F.lit(1))) & (p != "")
        follows = (nxt != "") & ~F.rlike(nxt, F.lit(f"(?iU){V.PARAGRAPH_STARTS}"))
        return F.struct(p.alias("p"), F.coalesce(is_open & follows, F.lit(False)).alias("joins"))

    def joined(marked):
        # an opening paragraph takes the next one whole, which then opens nothing
        flags = F.array_join(F.transform(marked, lambda x: F.when(x["joins"], "1").otherwise("0")), "")
        roles = F.filter(F.split(sub(flags, "1.", "JC"), ""), lambda c: c != "")
        return let(roles, lambda r: F.array_join(F.flatten(F.transform(
            marked, lambda x, i: F.when(F.get(r, i) == "J", F.array(F.concat(x["p"], F.lit(" "), F.get(marked, i + 1)["p"])))
            .when(F.get(r, i) == "C", empty("array<string>")).otherwise(F.array(x["p"])))), "\n\n"))

    return let(F.transform(parts, mark), joined)


def format_answer(text: Column) -> Column:
    """Lay out a legal answer: numerals, paragraphs and citations on own lines."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("*"), F.lit(""))
    for pattern, replacement, flags in V.ANSWER_LAYOUT:
        text = sub(text, pattern, replacement, flags)
    return strip(squeeze_spaces(text))


# ------------------------------------------------------------------- small

def strip_code_fence(text: Column) -> Column:
    return strip(sub(text, r"```(?:json)?\s*", "", "U"))


def strip_front_matter(text: Column) -> Column:
    """Drop a leading ``---`` block that closes with a line of ``---``."""
    def body(t):
        end = F.locate("\n---\n", t, 4)
        rest = strip(F.substring(t, end + 5, F.length(t)))
        return F.when(F.startswith(t, F.lit("---")) & (end > 0), rest).otherwise(t)

    return let(text, body)


def sanitize_name(stem: Column) -> Column:
    return sub(stem, r"[^\w\-]", "_", "U")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_suffix(path: Column) -> Column:
    """Extension with its dot, lower case; '' when there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def file_stem(path: Column) -> Column:
    return sub(file_name(path), r"^(.+)\.[^.]+$", "$1")


def tokens(text: Column) -> Column:
    """Lower-cased, whitespace-separated; no punctuation handling."""
    return let(strip(F.lower(text)), lambda t: F.when(t == "", empty("array<string>")).otherwise(
        F.split(t, r"(?U)\s+")))


def content_hash(content: Column) -> Column:
    """SHA-256 of the whole content, 64 hex digits."""
    return F.sha2(content.cast("binary"), 256)

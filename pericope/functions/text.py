"""Unicode text functions: normalisation, tokens, names and aliases.

normalised() and with_normalised() are exact for any text and stay in the JVM for
most: characters whose normal forms and case folding the JVM's own functions give
are handled there, and only texts with any other character go through a pandas
UDF. with_normalised() takes the two kinds apart, so that simple texts never meet
the UDF; normalised() is the same within one expression.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

WORD_CLASS = r"\p{L}\p{M}\p{N}"
TOKEN = rf"[{WORD_CLASS}]+(?:['’][{WORD_CLASS}]+)*"
_TOKEN_PATTERN = regex.compile(TOKEN)
#: ASCII, Latin-1 and Latin Extended-A but for four characters with unusual folding, and general punctuation up to the ellipsis and its kin.
_SIMPLE = r"^[\x00-\xB4\xB6-\x{12F}\x{131}-\x{148}\x{14A}-\x{17E}\x{2010}-\x{2027}]*$"
_ACCENTED = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x17F) if len(unicodedata.normalize("NFD", chr(c))) > 1}


def normalise(text: str, case_sensitive: bool = False, diacritics: str = "sensitive") -> str:
    """Composed form with single spaces; without non-spacing marks if diacritics is "insensitive"; folded unless case_sensitive."""
    out = " ".join(unicodedata.normalize("NFC", text).split())
    if diacritics == "insensitive":
        out = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", out) if unicodedata.category(c) != "Mn"))
    return out if case_sensitive else out.casefold()


def tokenise(text: str) -> list[str]:
    """Runs of letters, marks and digits, with apostrophes inside."""
    return _TOKEN_PATTERN.findall(text)


def normalise_name(name: str) -> str:
    """A book name as it is compared: folded, without marks, full stops and white space."""
    return "".join(normalise(name, False, "insensitive").replace(".", "").split())


def normalise_alias(name: str) -> str:
    """An alias as it is looked up: composed, without full stops, a leading number joined to its name, folded."""
    out = unicodedata.normalize("NFC", name).replace(".", "")
    out = regex.sub(r"(\d)\s+(\w)", r"\1\2", out)
    return " ".join(out.split()).casefold()


def _udf(case_sensitive: bool, diacritics: str):
    @pandas_udf("string")
    def exact(s: pd.Series) -> pd.Series:
        return s.map(lambda x: normalise(x, case_sensitive, diacritics), na_action="ignore")

    return exact


def native(text: Column, case_sensitive: bool = False, diacritics: str = "sensitive", spaced: bool = True) -> Column:
    """normalise() for texts of simple characters, within generated code. spaced=False leaves white space as it is."""
    out = F.trim(F.regexp_replace(text, r"[\s\x1C-\x1F\x85\xA0]+", " ")) if spaced else text
    if diacritics == "insensitive":
        out = F.translate(out, "".join(_ACCENTED), "".join(_ACCENTED.values()))
    return out if case_sensitive else F.replace(F.lower(out), F.lit("ß"), F.lit("ss"))


def simple(text: Column) -> Column:
    """Whether native() is exact for a text. ASCII is told by its length, without a regular expression."""
    return (F.octet_length(text) == F.length(text)) | text.rlike(_SIMPLE)


def computed(d: DataFrame, **columns: Column) -> DataFrame:
    """d with further columns, each computed once per row.

    Catalyst puts a projected expression in place of its name wherever a filter
    on it is pushed below the projection, and then computes it twice. Nothing
    passes below a generator, of one row here, which stays in generated code.
    """
    return d.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_normalised(d: DataFrame, text: str = "text", out: str = "norm", case_sensitive: bool = False, diacritics: str = "sensitive", exact: bool = True, keep: Callable[[Column], Column] | None = None, spaced: bool = True) -> DataFrame:
    """d with the normal form of a column. keep: which normal forms go on, tested before anything else is computed. spaced=False: white space may stay as it is. A null text stays null, unless keep drops it."""
    t = F.col(text)
    own = computed(d.where(simple(t) | t.isNull()) if exact else d, **{out: native(t, case_sensitive, diacritics, spaced)})
    if exact:
        rest = d.where(~simple(t)).withColumn(f"{out}_", _udf(case_sensitive, diacritics)(t))
        own = own.unionByName(computed(rest, **{out: F.col(f"{out}_")}).drop(f"{out}_"))
    return own.where(keep(F.col(out))) if keep else own


def holds(norm: Column, parts: list[str], every: bool) -> Column:
    """Whether a normal form holds every one, or any, of the parts; cheap, to be tested before texts are cut into tokens."""
    has = [F.contains(norm, F.lit(p)) for p in parts]
    out = has[0]
    for h in has[1:]:
        out = (out & h) if every else (out | h)
    return out


def normalised(text: Column, case_sensitive: bool = False, diacritics: str = "sensitive", exact: bool = True) -> Column:
    """normalise() of a column; null stays null. exact=False takes native() for every text."""
    if not exact:
        return native(text, case_sensitive, diacritics)
    rest = _udf(case_sensitive, diacritics)(F.when(~simple(text), text))
    return F.coalesce(rest, native(text, case_sensitive, diacritics))


def tokens(text: Column) -> Column:
    """tokenise() of a normalised column."""
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


@pandas_udf(T.StringType())
def alias_form(s: pd.Series) -> pd.Series:
    """normalise_alias() of a column."""
    return s.map(normalise_alias, na_action="ignore")

"""String functions of the catalogue: identifiers, acronyms, editions, file names.

Titles and file names are taken apart into words, and what a word means decides;
the only patterns are those that split.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that an acronym leaves out.
ACRONYM_SKIP = (
    "of on and the to in for a an with at or microdata file files collection pumf pumfs cycle"
).split()
# What stands between a title and what follows it.
SEPARATORS = (":", "-", "–", "—")
# Studies and kinds of file in the names of census files.
CENSUS_STUDIES = ("cen", "nhs")
CENSUS_KINDS = {"ind": "individuals", "fam": "families", "hous": "households", "hier": "hierarchical"}
# Words that mark the language in file names; the letters stand last.
ENGLISH_MARKS, ENGLISH_LETTER = ("eng", "en", "english", "anglais"), "e"
FRENCH_MARKS, FRENCH_LETTER = ("fra", "fr", "french", "francais", "français"), "f"
FRENCH_WORD = "recensement"


def normal_id(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def file_name(url: Column) -> Column:
    """The last part of a URL's path, without its query."""
    return F.element_at(F.split(F.split_part(url, F.lit("?"), F.lit(1)), "/"), -1)


def _parts(name: Column) -> Column:
    """A file name's words."""
    return F.split(name, r"[_.\-]")


def _digits(word: Column) -> Column:
    return (F.length(word) > 0) & (F.translate(word, "0123456789", "") == "")


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def _head(title: Column) -> Column:
    """A title's words up to the first that is, or ends in, a separator (without it)."""
    words = F.filter(F.split(F.trim(title), r"\s+"), lambda w: w != "")
    ends = F.transform(words, lambda w: F.right(w, F.lit(1)).isin(*SEPARATORS))
    at = F.array_position(ends, F.lit(True))
    own = lambda w: F.when(F.right(w, F.lit(1)).isin(*SEPARATORS), F.left(w, F.length(w) - 1)).otherwise(w)
    kept = F.when((at > 0) & (at < F.size(words)), F.slice(words, F.lit(1), at.cast("int"))).otherwise(words)
    return F.filter(F.transform(kept, own), lambda w: w != "")


def acronym(title: Column) -> Column:
    """A title's bracketed acronym, else its words' initials; census titles are Census."""
    words = F.split(F.lower(title), r"[^a-z0-9]+")
    inside = F.filter(F.transform(F.split(title, r"\("), lambda x: F.split_part(x, F.lit(")"), F.lit(1))), lambda x: F.contains(title, F.concat(F.lit("("), x, F.lit(")"))))
    capitals = lambda x: F.length(x) - F.length(F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    is_short = lambda x: ~F.contains(x, F.lit(" ")) & (capitals(F.left(x, F.lit(1))) == 1) & (capitals(x) > 1) & ~F.lower(x).isin("pumf", "pumfs")
    bracketed = F.get(F.filter(inside, is_short), 0)
    plain = F.filter(F.split(F.array_join(_head(title), " "), r"[^A-Za-z0-9]+"), lambda w: (w != "") & ~_digits(w) & ~F.lower(w).isin(ACRONYM_SKIP))
    initials = F.upper(F.array_join(F.transform(plain, lambda w: F.left(w, F.lit(1))), ""))
    return F.when(F.array_contains(words, "census"), "Census").otherwise(F.coalesce(bracketed, F.nullif(initials, F.lit(""))))


def series_title(title: Column) -> Column:
    """A title's words without what follows it and without the edition at its end:
    years, numbers and the word Cycle."""
    words = _head(title)
    solid = F.transform(words, lambda w: ~(_digits(F.translate(w, "(),;", "")) | (F.lower(F.translate(w, ",;", "")) == "cycle")))
    last = F.size(words) - F.array_position(F.reverse(solid), F.lit(True)) + 1
    kept = F.array_join(F.slice(words, F.lit(1), F.greatest(F.lit(0), last.cast("int"))), " ")
    return F.when(title.isNotNull(), F.rtrim(kept, F.lit(",; ")))


def cycle_version(title: Column, edition: Column) -> Column:
    """The number after the word Series or Cycle, else the edition."""
    words = F.split(F.lower(title), r"[^a-z0-9]+")
    at = F.greatest(F.array_position(words, F.lit("series")), F.array_position(words, F.lit("cycle")))
    number = F.get(words, at.cast("int"))
    return F.when((at > 0) & _digits(F.coalesce(number, F.lit(""))), number).otherwise(edition)


def census_edition(url: Column) -> Column:
    """``YYYY (kind)`` by the first two words of a census file's name, such as
    cen16_ind; years 00 to 30 are of this century. Null for other names."""
    parts = _parts(F.lower(file_name(url)))
    first, kind = F.get(parts, 0), _lookup(CENSUS_KINDS, F.get(parts, 1))
    two = F.substring(first, 4, 9)
    year = F.when(_digits(two) & (F.length(two) == 2), two.try_cast("int"))
    century = F.when(year <= 30, year + 2000).otherwise(year + 1900)
    # Most names are of no census, and told by their first letters before they are cut.
    of_census = F.left(F.lower(file_name(url)), F.lit(3)).isin(*CENSUS_STUDIES)
    known = F.left(first, F.lit(3)).isin(*CENSUS_STUDIES) & year.isNotNull() & kind.isNotNull() & (F.size(parts) > 3)
    return F.when(of_census & known, F.concat(century.cast("string"), F.lit(" ("), kind, F.lit(")")))


def gss_version(url: Column, edition: Column) -> Column:
    """``Cycle N (YYYY)`` or ``PREFIX (YYYY)`` by the file name, else the edition."""
    parts = _parts(file_name(url))
    year = F.coalesce(F.get(F.filter(parts, lambda w: _digits(w) & (F.length(w) == 4)), 0), edition)
    first = F.upper(F.get(parts, 0))
    cycle = F.when(F.startswith(first, F.lit("C")) & _digits(F.substring(first, 2, 9)), F.substring(first, 2, 9))
    # This name carries no cycle number; these are no cycles.
    cycle = F.coalesce(cycle, F.when((first == "TU") & (F.upper(F.get(parts, 1)) == "ET"), "36"))
    label = F.coalesce(F.concat(F.lit("Cycle "), cycle), F.when(first.isin("NSGVP", "CSGVP", "GVP"), first))
    return F.coalesce(F.concat(label, F.lit(" ("), year, F.lit(")")), edition)


def language_score(path: Column, lang: str) -> Column:
    """2 if a file name is marked as of the language, 1 if of neither, 0 if of the other."""
    parts = _parts(F.lower(F.element_at(F.split(path, "/"), -1)))
    last = F.get(parts, F.size(parts) - 2)
    marked = lambda words, letter: F.arrays_overlap(parts, F.array(*[F.lit(w) for w in words])) | F.coalesce((last == letter) & (F.size(parts) > 2), F.lit(False))
    english = marked(ENGLISH_MARKS, ENGLISH_LETTER)
    french = marked(FRENCH_MARKS, FRENCH_LETTER) | F.contains(F.array_join(parts, "_"), F.lit(FRENCH_WORD))
    own, other = (english, french) if lang == "eng" else (french, english)
    return F.when(own, 2).when(~other, 1).otherwise(0)


def language_score_of(path: str, lang: str) -> int:
    """``language_score`` of one path, on the driver."""
    import re

    parts = re.split(r"[_.\-]", path.rsplit("/", 1)[-1].lower())
    last = parts[-2] if len(parts) > 2 else ""
    english = bool(set(parts) & set(ENGLISH_MARKS)) or last == ENGLISH_LETTER
    french = bool(set(parts) & set(FRENCH_MARKS)) or last == FRENCH_LETTER or FRENCH_WORD in "_".join(parts)
    own, other = (english, french) if lang == "eng" else (french, english)
    return 2 if own else 0 if other else 1


def links(html: Column) -> Column:
    """All href targets of a page, in order."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)href\s*=\s*["']([^"']*)["']"""), F.lit(1))

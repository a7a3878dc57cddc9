"""What is special about each survey version: configuration, aliases, inheritance."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, fields, replace

from ..model import Code, Fixups
from .entries import CENSUS, GSS, SGVP, Entry


@dataclass(frozen=True)
class ModuleTable:
    name: str
    primary: bool
    entry: Entry


class Registry:
    def __init__(self, entries: list[Entry] | None = None):
        self.entries = {(e.series, e.version): e for e in (BUILT_IN if entries is None else entries)}
        self._override: dict[str, object] | None = None

    def newest_sibling(self, series: str, version: str) -> Entry | None:
        """REG-04/SRT-05: of versions that are bare years the newest up to the one
        asked for, else the oldest."""
        if not re.fullmatch(r"\d{4}", version):
            return None
        years = sorted(v for s, v in self.entries if s == series and re.fullmatch(r"\d{4}", v))
        if not years:
            return None
        older = [y for y in years if y <= version]
        return self.entries[(series, older[-1] if older else years[0])]

    def lookup(self, series: str, version: str) -> Entry:
        """REG-03: the entry, else what a sibling has, with the override on top."""
        found = self.entries.get((series, version)) or self.newest_sibling(series, version)
        found = replace(found, version=version) if found else Entry(series, version)
        return replace(found, **self._override) if self._override else found

    def overridden(self, **values):
        """REG-08: a copy of the registry in which these fields hold for all look-ups."""
        known = {f.name for f in fields(Entry)} - {"series", "version"}
        if bad := set(values) - known:
            raise ValueError(f"unknown fields: {', '.join(sorted(bad))}")
        if isinstance(fix := values.get("fixups"), Fixups):
            fix.check()
        out = Registry(list(self.entries.values()))
        out._override = values
        return out

    def with_numeric(self, names: Iterable[tuple[str, str, str, str]]) -> Registry:
        """A copy in which the variables given as (series, version, module, name), the
        module empty for surveys of one table, are numbers in spite of their codes."""
        by: dict[tuple[str, str], dict[str, list[str]]] = {}
        for series, version, module, name in names:
            by.setdefault((series, version), {}).setdefault(module or "", []).append(name)
        out = Registry(list(self.entries.values()))
        out._override = self._override
        for key, found in by.items():
            if key not in out.entries:
                raise ValueError(f"unknown survey: {' '.join(key)}")
            e = out.entries[key]
            own = found.pop("", [])
            if unknown := set(found) - set(e.modules):
                raise ValueError(f"{' '.join(key)} has no module {', '.join(sorted(unknown))}")
            modules = {m: patch | {"fixups": _and_numeric(patch.get("fixups", e.fixups), found[m])} if m in found else patch for m, patch in e.modules.items()}
            out.entries[key] = replace(e, fixups=_and_numeric(e.fixups, own), modules=modules)
        return out

    def versions(self, series: str) -> list[str]:
        return [v for s, v in self.entries if s == series]

    def modules(self, series: str, version: str) -> list[ModuleTable]:
        """MOD-01: the module tables, the first being primary."""
        e = self.lookup(series, version)
        if not e.modules:
            return [ModuleTable("", True, e)]
        return [ModuleTable(name, k == 0, replace(e, **patch)) for k, (name, patch) in enumerate(e.modules.items())]

    def table(self) -> list[dict]:
        """REG-07: one row an entry, with what it sets."""
        default = Entry("", "")
        return [
            {"series": s, "version": v, "sets": sorted(f.name for f in fields(Entry) if f.name not in ("series", "version") and getattr(e, f.name) != getattr(default, f.name))}
            for (s, v), e in sorted(self.entries.items())
        ]


def _and_numeric(fix: Fixups, names: list[str]) -> Fixups:
    return replace(fix, force_numeric=(*fix.force_numeric, *(n for n in dict.fromkeys(names) if n not in fix.force_numeric))).check()


# Names under which cycles of the GSS are known besides their numbers.
THEMES = {
    "Cycle 8 (1993)": ("safety", "personal risk", "victimization"),
    "Cycle 9 (1994)": ("education",),
    "Cycle 10 (1995)": ("family",),
    "Cycle 12 (1998)": ("time use",),
    "Cycle 13 (1999)": ("safety", "victimization"),
    "Cycle 15 (2001)": ("family",),
    "Cycle 16 (2002)": ("aging and social support",),
    "Cycle 17 (2003)": ("social identity", "social engagement"),
    "Cycle 21 (2007)": ("education", "family"),
    "Cycle 24 (2010)": ("time use",),
    "Cycle 25 (2011)": ("family",),
    "Cycle 26 (2012)": ("caregiving",),
    "Cycle 27 (2013)": ("social identity",),
    "Cycle 28 (2014)": ("safety", "victimization"),
    "Cycle 29 (2015)": ("time use",),
    "Cycle 31 (2017)": ("family",),
    "Cycle 32 (2018)": ("caregiving",),
    "Cycle 34 (2019)": ("safety", "victimization"),
    "Cycle 35 (2020)": ("social identity",),
    "Cycle 36 (2022)": ("time use",),
}
# Kinds of census files, the one that is meant where none is named first,
# and the area that needs no naming.
CENSUS_KINDS, CENSUS_AREA = ("individuals", "households", "families", "hierarchical"), "prov"


def _alike(a: str, b: str) -> bool:
    """Whether two words are forms of one, such as family and families."""
    return a[:5] == b[:5]


def _census(words: tuple[str, ...], known: list[str]) -> str:
    """The year's version that has all words asked for and the fewest others."""
    year, *asked = words
    kind = next((k for k in CENSUS_KINDS for w in asked if _alike(k, w)), CENSUS_KINDS[0])
    of_year = {v: _words(v)[1:] for v in known if _words(v)[:1] == (year,)}
    for wanted in ([kind, *asked], [kind]):
        fits = [v for v, has in of_year.items() if all(any(_alike(w, h) for h in has) for w in wanted)]
        if fits:
            others = lambda v: sum(not any(_alike(h, w) for w in (*wanted, CENSUS_AREA)) for h in of_year[v])
            return min(fits, key=lambda v: (others(v), CENSUS_AREA not in of_year[v]))
    return f"{year} ({kind})"


def _words(text: str) -> tuple[str, ...]:
    """Lower-case words, numbers apart from the letters before them."""
    return tuple(re.findall(r"[a-z]+|\d+", text.lower()))


def resolve_version(series: str, version: str, known: list[str]) -> str:
    """REG-05: an alias to a known version; several matches are an error, and what
    is no alias stays as it is.

    A cycle goes by its number, its year, both, or its theme and year; the
    bare-numbered series by ``Cycle N``, ``Series N`` or their acronym and N; a
    census by its year and the kind of file.
    """
    if version in known:
        return version
    words = _words(version)
    if series in ("CPSS", "CCAHS"):
        if series == "CCAHS" and words == ("2022",):
            return "1"
        return words[1] if len(words) == 2 and words[0] in ("cycle", "series", series.lower()) else version
    if series == "Census" and words and re.fullmatch(r"\d{4}", words[0]):
        return _census(words, known)
    hits = []
    for v in known:
        if m := re.fullmatch(r"Cycle (\d+) \((\d{4})\)", v):
            n, year = m.groups()
            names = {("cycle", n), (n,), (year,), ("cycle", n, year)} | {(*_words(t), year) for t in THEMES.get(v, ())}
            if v == "Cycle 16 (2002)":
                names.add(_words(THEMES[v][0]))
            if words in names:
                hits.append(v)
    if len(hits) > 1:
        raise ValueError(f"{series} {version} is ambiguous: {', '.join(hits)}")
    return hits[0] if hits else version


def _shipped(series: str, version: str, key: str, bsw: str, **more) -> Entry:
    return Entry(series, version, bsw_join_key=key, bsw_file_mask=bsw, **more)


_FAMILY = {"bsw_drop": ("PWEIGHT",), "file_mask": r"EFAM_PUMF\.txt"}
_TERRITORIES = lambda en, fr: Fixups(codes_supplement=(Code("PPROV", "95", en, fr),))

# What the files of each version are named, and how they are joined
# (those of GSS, SGVP and Census are in entries.py).
BUILT_IN = [
    _shipped("SFS", "2023", "PEFAMID", r"BSWEIGHTS_PUMF\.txt", bsw_mask="bsweights_pumf", layout_mask="EFAM_PUMF_[^R]", **_FAMILY),
    _shipped("SFS", "2019", "PEFAMID", r"BSWEIGHTS_PUMF\.txt", bsw_mask="bsweights", layout_mask="EFAM_PUMF", **_FAMILY),
    _shipped("SFS", "2016", "PEFAMID", r"BSWEIGHTS_PUMF\.txt", bsw_mask="bsweights", layout_mask="EFAM_PUMF", **_FAMILY),
    Entry("SFS", "2012"),
    Entry("SFS", "2005", file_mask=r"ec2005ef\.txt", fixups=Fixups(force_numeric=("WEIGHT",))),
    Entry("SFS", "1999", file_mask=r"ec1999ef\.sdf"),
    *[Entry("CIS", str(year), file_mask=r"PUMF\.txt") for year in range(2022, 2016, -1)],
    Entry("CHS", "2018", layout_mask="chs2018ecl_pumf", file_mask=r"CHS2018ECL_PUMF\.csv", fixups=_TERRITORIES("Territories", "Territoires")),
    _shipped("CHS", "2021", "PUMFID", r"chs\d{4}ecl_PUMF_bsw\.csv", layout_mask=r"CHS\d{4}ECL_PUMF", file_mask=r"CHS\d{4}ECL_PUMF\.csv", fixups=_TERRITORIES("Territorial capitals", "Capitales territoriales")),
    _shipped("CHS", "2022", "PUMFID", r"chs\d{4}ecl_pumf_bsw\.csv", layout_mask=r"chs\d{4}ecl_pumf", file_mask=r"chs\d{4}ecl_pumf\.csv"),
    Entry("SHS", "2017", module_key="CASEID", modules={
        "Interview": {"layout_mask": "Interview", "file_mask": r"interview_flatfile\.txt", "bsw_file_mask": r"interview_bsw_flatfile\.txt", "bsw_join_key": "CASEID"},
        "Diary": {"layout_mask": "Diary", "file_mask": r"diary_flatfile\.txt", "bsw_file_mask": r"diary_bsw_flatfile\.txt", "bsw_join_key": "CASEID"},
    }),
    _shipped("SHS", "2019", "CASEID", r"bsw_flatfile\.txt", bsw_mask="_bsw_flatfile", layout_mask="shs2019_flatfile", file_mask=r"shs2019_flatfile\.txt"),
    _shipped("SHS", "2021", "CASEID", r"bsw_flatfile\.txt", file_mask=r"PUMF_SHS_\d{4}\.txt"),
    _shipped("SHS", "2023", "CASEID", r"bsw_flatfile\.txt", file_mask=r"PUMF_SHS_\d{4}\.txt"),
    Entry("CPSS", "1", fixups=Fixups(force_numeric=("COVID_WT",), labels_supplement={"COVID_WT": ("Survey weight", "Poids d'enquête")})),
    *GSS,
    _shipped("CCAHS", "1", "PUMFID", r"ccahs_bsw_pumf\.csv", bsw_drop=("WGT_PUMF",), layout_mask="CCAHS_PUMF", file_mask=r"ccahs_pumf\.csv"),
    *SGVP,
    Entry("ITS", "2018", file_mask=r"VTS_\d{4}_PUMF\.txt"),
    Entry("ITS", "2019", file_mask=r"VTS_\d{4}_PUMF\.txt"),
    *CENSUS,
    Entry("LFS", "", bsw_strata=("SURVYEAR", "SURVMNTH"), fixups=Fixups(force_integer=("SURVYEAR", "SURVMNTH", "REC_NUM"))),
]

"""What is special about the versions of the general social survey, of giving and
volunteering, and of the census. Versions of which very many variables are numeric
in spite of their codes take those names from ``Registry.with_numeric``."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..model import Code, Fixups


@dataclass(frozen=True)
class Entry:
    """One survey version's configuration; fields at their default are not set."""

    series: str
    version: str
    file_mask: str | None = None
    layout_mask: str | None = None
    data_encoding: str = "CP1252"
    metadata_encoding: str = "CP1252"
    bsw_mask: str | None = None
    bsw_file_mask: str | None = None
    bsw_join_key: str | None = None
    bsw_drop: tuple[str, ...] = ()
    bsw_strata: tuple[str, ...] = ()
    modules: dict = field(default_factory=dict)
    module_key: str | None = None
    doc_mask: str | None = None
    english_commands: str | None = None  # path of an English command file that the archive lacks
    fixups: Fixups = field(default_factory=Fixups)


def _numeric(names: str) -> Fixups:
    return Fixups(force_numeric=tuple(names.split()))


def _module(layout: str, file: str, fixups: Fixups | None = None) -> dict:
    return {"layout_mask": layout, "file_mask": file} | ({"fixups": fixups} if fixups else {})


# Files of each cycle, and variables that are numbers though they have codes.
GSS = [
    Entry("GSS", "Cycle 8 (1993)", file_mask=r"C8MICRO\.DAT", metadata_encoding="CP850", fixups=_numeric(
        "DVB10A DVD5D6VL DVWKVOL D11 DVD12VOL DVD13VOL DVD14VOL DVSETVOL DVD12SET DVD13SET DVD14SET DVE28 "
        "DVE30 DVE33 DVF23NGT DVF25DAY DVF33DAY DVF36COL DVG38COL DVG45COL DVG51COL DVG53DAY")),
    Entry("GSS", "Cycle 9 (1994)", file_mask=r"C9micro\.dat", fixups=_numeric("DVD7 DVEXREAG L11")),
    Entry("GSS", "Cycle 10 (1995)", file_mask=r"C10micme\.dat", metadata_encoding="CP850"),
    Entry("GSS", "Cycle 11 (1996)", file_mask=r"c11mice\.dat", metadata_encoding="CP850"),
    Entry("GSS", "Cycle 12 (1998)", module_key="RECID", modules={
        "Main": _module("C12micm", r"C12MICME\.DAT"),
        "Episode": _module("C12mice", r"C12MICEE\.DAT"),
    }),
    Entry("GSS", "Cycle 13 (1999)", layout_mask="c13micm", file_mask=r"C13MICM\.DAT"),
    Entry("GSS", "Cycle 15 (2001)", file_mask=r"C15PUMFM\.DAT"),
    Entry("GSS", "Cycle 16 (2002)", module_key="RECID", modules={
        "MAIN": _module("C16PUMF_MAIN", r"C16PUMF_MAIN\.DAT"),
        "CG4": _module("C16PUMF_CG4", r"C16PUMF_CG4\.DAT"),
        "CG6": _module("C16PUMF_CG6", r"C16PUMF_CG6\.DAT"),
        "CR": _module("C16PUMF_CR", r"C16PUMF_CR\.DAT"),
    }),
    Entry("GSS", "Cycle 17 (2003)", file_mask=r"C17PUMFM\.DAT"),
    Entry("GSS", "Cycle 21 (2007)", file_mask=r"C21PUMFM\.DAT"),
    Entry("GSS", "Cycle 24 (2010)", module_key="RECID", modules={
        "Main": _module("SPSS_PUMF", r"C24PUMFM\.DAT"),
        "Episode": _module("_SPSS_(withno|sans)_bootstrap", r"C24EPISODE_withno_bootstrap\.DAT"),
    }),
    Entry("GSS", "Cycle 25 (2011)", file_mask=r"C25PUMF\.DAT"),
    Entry("GSS", "Cycle 26 (2012)", file_mask=r"GSS26PUMFM\.DAT", fixups=_numeric(
        "AGEHSDYC NLC_Q100C HAR_Q10C NPA_Q10C HAP_Q10C PRN_Q30C DOA_Q30C AGE_CGI_01_BEGC AGE_CGI_01_ENDC "
        "AGE_CGI_02_BEGC AGE_CGI_02_ENDC AGE_CGI_03_BEGC AGE_CGI_03_ENDC AGE_CGI_04_BEGC AGE_CGI_04_ENDC "
        "AGE_CGI_05_BEGC AGE_CGI_05_ENDC WHW_Q120C WHW_Q130C WHW_Q140C ITL_Q10 ITL_Q40C ITA_Q10 "
        "IPE_Q10GR IPO_Q10GR IPO_Q20GR PHS_Q10")),
    Entry("GSS", "Cycle 27 (2013)", fixups=_numeric(
        "RECID HSDSIZEC AGEHSDYC CHINHSDC CHH0014C RFE_10C RFE_20C SCF_100C SCF_102C SCF_110C CWF_20C SCP_110 "
        "SCP_120C CERD230C GRP_10C GRP_20C IWO_10C MCR_300C MCR_325C MCR_330C MCR_335C WET_110 AGELPDWC WHW_210 HSDELIGC")),
    Entry("GSS", "Cycle 28 (2014)", layout_mask="GSS28PUMFM", file_mask=r"GSS28PUMFM\.txt"),
    Entry("GSS", "Cycle 29 (2015)", module_key="PUMFID", modules={
        "Main": _module("c29pumf_", r"GSS29PUMFM\.txt", _numeric(
            "LOCATION TUI_06A TUI_06B TUI_06C TUI_06D TUI_06E TUI_06F TUI_06G TUI_06H TUI_06I TUI_06J TUI_03A "
            "TUI_03B TUI_07 TECHFLAG TUI_10 AGEHSDYC AGELSWKC WLY_170C")),
        "Episode": _module("c29pumfe_", r"GSS29PUMFE\.txt"),
    }),
    Entry("GSS", "Cycle 31 (2017)", file_mask=r"GSS31PUMF\.txt"),
    Entry("GSS", "Cycle 32 (2018)", file_mask=r"C32PUMFM\.txt", fixups=_numeric(
        "AGEHSDYC DPA_10 PAR_10 DVCG120C RNA_10C RNA_20C RNA_30C RNA_40C DNA_10C DNA_15C DVDNA20C DNA_31C "
        "DNA_32C DNA_33C DNA_34C ITA_10C IPA_21C IPA_22C IPA_23C PHS_10C")),
    Entry("GSS", "Cycle 34 (2019)", layout_mask="GSS34PUMFM", file_mask=r"GSS34PUMFM\.txt", fixups=_numeric("NUMEVACT")),
    Entry("GSS", "Cycle 35 (2020)", layout_mask="GSS35PUMFM", file_mask=r"GSS35PUMFM\.txt"),
    Entry("GSS", "Cycle 36 (2022)", module_key="PUMFID", modules={
        "Main": _module("_Main_", r"Main-Principal_PUMF\.txt"),
        "Episode": _module("_Episode_", r"Episode_PUMF\.txt", _numeric("ACTIVITY LOCATION TUI_01 TUI_03")),
    }),
]

# Files of each version.
SGVP = [
    Entry("SGVP", "2023", file_mask=r"GVP_DBP_\d{4}_PUMF_FMGD\.txt", fixups=_numeric("HSDSIZEC")),
    Entry("SGVP", "2018", layout_mask="GSS33PUMF", file_mask=r"GSS33PUMF\.txt$", fixups=Fixups(force_numeric=("HSDSIZEC", "DSCORE"), codes_supplement=(Code("BRTHMACR", "9"),))),
    Entry("SGVP", "2013", file_mask=r"GVP_PUMF_MAIN\.txt", fixups=_numeric("HSDSIZEC CHH0014C")),
    Entry("SGVP", "2010", module_key="PUMFID", modules={
        "MAIN": _module("_MAIN_", r"CSGVP2010_MAIN_PUMF\.txt$"),
        "GS": _module("GIVING|_GS_", r"CSGVP2010_GS_PUMF\.txt$"),
    }),
    Entry("SGVP", "2007", module_key="PUMFID", modules={
        "MAIN": _module("_MAIN_", r"CSGVP2007_MAIN_PUMF\.txt$"),
        "GS": _module("_GS_", r"CSGVP2007_GS_PUMF\.txt$"),
    }),
    Entry("SGVP", "2004", module_key="PUMFID", modules={
        "MAIN": _module("_MAIN_", r"CSGVP2004_MAIN_PUMF\.txt$"),
        "GS": _module("_GS_", r"CSGVP2004_GS_PUMF\.txt$"),
    }),
    Entry("SGVP", "2000", module_key="MICRO_ID", modules={
        "MAIN": _module("_MAIN_", r"NSGVP2000_MAIN_PUMF\.txt$"),
        "GS": _module("_GS_", r"NSGVP2000_GS_PUMF\.txt$"),
        "VD": _module("_VD_", r"NSGVP2000_VD_PUMF\.txt$"),
    }),
    Entry("SGVP", "1997", module_key="IDNUM", modules={
        "MAIN": _module("_SGVP_", r"NSGVP1997_SGVP_PUMF\.txt$", Fixups(force_numeric=("AQ03",), na_values=(".",))),
        "GIVE": _module("_GIVE_", r"NSGVP1997_GIVE_PUMF\.txt$", Fixups(na_values=(".",))),
        "VOLNTR": _module("_VOLNTR_", r"NSGVP1997_VOLNTR_PUMF\.txt$", Fixups(na_values=(".",))),
    }),
]


def _census(version: str, file: str, na: tuple[str, ...] = ("9999999", "8888888"), more: tuple[Code, ...] = (), **other) -> Entry:
    return Entry("Census", version, file_mask=file, fixups=Fixups(na_values=na, codes_supplement=more), **other)


_EIGHT = ("99999999", "88888888")
_NO_DATA = ("Data not available", "Données non disponibles")


def _census_1971(kind: str, file: str, more: tuple[Code, ...] = ()) -> Entry:
    """The number of a subsample has a label for 1 alone."""
    return Entry("Census", f"1971/{kind}", layout_mask=file, file_mask=rf"^{file}\.txt$", fixups=Fixups(force_numeric=("SUBSAMPL",), codes_supplement=more))


# Files of each census, what stands for missing, and codes that its command files lack.
CENSUS = [
    Entry("Census", "2021 (individuals)", metadata_encoding="UTF-8", file_mask=r"\.csv", doc_mask="User Guide", fixups=Fixups(na_values=_EIGHT, rename={"RELIGION_DER": "RELIG"})),
    _census("2021 (hierarchical)", r"\.csv", _EIGHT, metadata_encoding="UTF-8"),
    _census("2016 (individuals)", r"\.dat", _EIGHT),
    _census("2016 (hierarchical)", r"\.dat", _EIGHT),
    _census("2011 (individuals)", r"\.dat"),
    _census("2011 (hierarchical)", r"\.dat"),
    _census("2006 (individuals)", r"\.dat"),
    _census("2006 (hierarchical)", r"\.dat", more=(Code("MORGH", "8", "Not available", "Non disponible"),)),
    _census("2001 (individuals)", r"\.dat"),
    _census("2001 (households)", r"\.dat"),
    _census("2001 (families)", r"\.dat", more=(Code("MODEF", "7", "Other method", "Autre moyen"),)),
    _census("1996 (individuals)", r"^indiv\.dat$"),
    _census("1996 (households)", r"^hhldv2\.dat$"),
    _census("1996 (families)", r"^fam\.dat$"),
    _census("1991 (individuals)", r"PUMF91\.INDIV", more=(Code("NOLGREP", "9", "Not applicable", "Sans objet"),), metadata_encoding="CP850"),
    _census("1991 (households)", r"PUMF91\.HHLD", metadata_encoding="CP850"),
    _census("1991 (families)", r"PUMF91\.FAM", metadata_encoding="CP850"),
    Entry("Census", "1986/individuals", layout_mask="ind86", file_mask=r"^INDIV86\.DAT$", doc_mask="Individu|[Pp]articulier|indvls", fixups=Fixups(
        force_numeric=("AGEP", "HRSWK", "WKSWK", "TOTINCP", "WAGESP", "SELFIP", "INVSTP", "RETIRP", "OTINCP"),
        codes_supplement=(
            Code("ETHNICOR", "29", "Other European single responses (Atl/YT/NWT)", "Autres origines uniques européennes (Atl/YN/TNO)"),
            Code("ETHNICOR", "30", "Asian (Atl/YT/NWT)", "Asiatique (Atl/YN/TNO)"),
        ))),
    Entry("Census", "1986/households", layout_mask="hhld86", file_mask=r"^HHLD86\.DAT$", doc_mask="Household|[Mm][eé]nages|hhldhsg", fixups=_numeric(
        "VALUEH GROSRTH RENTH OMPH MPPIT HMAGE HMWKSWK HMTOTINC SPAGE SPWKSWK SPTOTINC")),
    Entry("Census", "1986/families", layout_mask="fam", file_mask=r"^FAM86\.DAT$", doc_mask="Family|Familles", fixups=Fixups(na_values=("999999",))),
    Entry("Census", "1981/individuals", layout_mask="ind81", file_mask=r"^INDMDF81\.DAT$", fixups=Fixups(cols_swap=(("WKACTMA", "WKACTFA"), ("FAOCC81", "MAOCC81"), ("FALFACT", "MALFACT")))),
    Entry("Census", "1981/households", layout_mask="hhmdf81", file_mask=r"^HHMDF81\.DAT$"),
    Entry("Census", "1976/individuals", layout_mask="indiv76", file_mask=r"^indiv76\.txt$"),
    Entry("Census", "1976/households", layout_mask="hhld76", file_mask=r"^hhld76\.txt$"),
    Entry("Census", "1976/families", layout_mask="fam76", file_mask=r"^fam76\.txt$"),
    _census_1971("individuals_prov", "indiv71_prov"),
    _census_1971("individuals_cma", "indiv71_cma", (Code("TYPE66", "0", *_NO_DATA), Code("TYPE71", "0", *_NO_DATA))),
    _census_1971("households_prov", "hhld71_prov"),
    _census_1971("households_cma", "hhld71_cma"),
    _census_1971("families_prov", "fam71_prov", (Code("CMACODE", "000"),)),
    _census_1971("families_cma", "fam71_cma"),
]

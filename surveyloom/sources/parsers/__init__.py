"""Readers of command files and codebooks; each gives canonical metadata.

Such files are kilobytes, so they are read by plain Python on the driver.
"""

from .codebooks import parse_cpss, parse_lfs_codebook
from .dictionaries import parse_codebook, parse_dictionary
from .sas import parse_cards, parse_labels
from .sav import parse_sav
from .spss import parse_mono, parse_split

__all__ = ["parse_cards", "parse_codebook", "parse_cpss", "parse_dictionary", "parse_labels", "parse_lfs_codebook", "parse_mono", "parse_sav", "parse_split"]

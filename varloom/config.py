"""Filter files (INI) as frozen settings."""

from __future__ import annotations

import configparser
from pathlib import Path

from varloom.functions.clinical import FilterConfig

_TRUE = {"yes", "true", "on", "1", "y"}


def truth(text: str | None, default: bool = False) -> bool:
    """yes / no text as a boolean; a source set to no is off."""
    return default if text is None else text.strip().lower() in _TRUE


def filter_config(path: str, gene_list: str | None = None) -> FilterConfig:
    """Sections fltr (incl, excl), infoflag, freq and freq_cli (sources, maf), reg (splice distance), vartype and gid."""
    ini = configparser.ConfigParser(allow_no_value=True, inline_comment_prefixes=("#", ";"))
    ini.optionxform = str
    ini.read_string(Path(path).read_text())
    listed = lambda section, key: tuple(x.strip() for x in (ini.get(section, key, fallback="") or "").split(",") if x.strip())
    freq = dict(ini["freq"]) if ini.has_section("freq") else {}
    genes = tuple(g for g in Path(gene_list).read_text().split() if not g.startswith("#")) if gene_list else listed("gid", "incl")
    return FilterConfig(
        filter_include=listed("fltr", "incl"),
        filter_exclude=listed("fltr", "excl"),
        flag_include=listed("infoflag", "incl"),
        flag_exclude=listed("infoflag", "excl"),
        frequency=float(freq.get("maf") or 0.01),
        clinical_frequency=float(ini.get("freq_cli", "maf", fallback=None) or 0.05),
        splice_distance=int(ini.get("reg", "splice", fallback=None) or 20),
        regions=tuple(r for r in listed("reg", "incl") if r != "all"),
        variant_types=listed("vartype", "incl") or ("snp", "indel"),
        genes=genes,
        sources={k: truth(v) for k, v in freq.items() if k != "maf"},
    )

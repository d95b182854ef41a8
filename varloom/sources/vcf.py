"""VCF scan and sink. Header lines are small and parsed on the driver; records stay columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.sources import lines as splits
from varloom.sources import tables

FIXED = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info")
_TYPES = {"Integer": T.IntegerType(), "Float": T.DoubleType(), "Flag": T.BooleanType(), "String": T.StringType(), "Character": T.StringType()}


def _caster(kind: T.DataType):
    return lambda x: x.try_cast(kind)


def _looker(values: Column):
    return lambda key: F.coalesce(F.try_element_at(values, key), F.lit("."))


def quoted_split(text: str, sep: str = ",") -> list[str]:
    """Parts of a text at separators outside of double quotes; the quotes go.

    >>> quoted_split('ID=X,Description="a, b"')
    ['ID=X', 'Description=a, b']
    """
    parts, held, quoted = [], [], False
    for ch in text:
        if ch == '"':
            quoted = not quoted
        elif ch == sep and not quoted:
            parts.append("".join(held))
            held = []
        else:
            held.append(ch)
    return [*parts, "".join(held)]


def parse_meta(line: str) -> tuple[str, str | dict[str, str]]:
    """Key and value of a ## line; structured values become dictionaries.

    >>> parse_meta('##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">')
    ('INFO', {'ID': 'DP', 'Number': '1', 'Type': 'Integer', 'Description': 'Depth'})
    """
    key, _, value = line.strip().lstrip("#").partition("=")
    if value.startswith("<") and value.endswith(">"):
        return key, dict(p.partition("=")[::2] for p in quoted_split(value[1:-1]))
    return key, value


@dataclass
class Header:
    meta: dict[str, dict[str, dict[str, str]]] = field(default_factory=dict)
    plain: list[tuple[str, str]] = field(default_factory=list)
    samples: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, lines: list[str]) -> Header:
        out = cls()
        for line in lines:
            if line.startswith("##"):
                key, value = parse_meta(line)
                if isinstance(value, dict) and "ID" in value:
                    out.meta.setdefault(key, {})[value["ID"]] = value
                else:
                    out.plain.append((key, value if isinstance(value, str) else line.partition("=")[2]))
            elif line.startswith("#"):
                out.samples = line.rstrip("\n").split("\t")[9:]
        return out

    def add(self, kind: str, ident: str, number: str, type_: str, description: str) -> None:
        self.meta.setdefault(kind, {})[ident] = {"ID": ident, "Number": number, "Type": type_, "Description": description}

    def define(self, kind: str, definitions: DataFrame) -> None:
        """Add a source's definitions (id, count, type, description): a table as small as the header that they go into."""
        for r in definitions.select("id", "count", "type", "description").orderBy("id").collect():
            self.add(kind, r["id"], r["count"], r["type"], r["description"])

    def drop(self, kind: str, idents: list[str]) -> None:
        for i in idents:
            self.meta.get(kind, {}).pop(i, None)

    def lines(self) -> list[str]:
        out = [f"##{k}={v}" for k, v in self.plain]
        for kind, entries in self.meta.items():
            for e in entries.values():
                out.append(f"##{kind}=<" + ",".join(f'{k}="{v}"' if k == "Description" or "," in v or " " in v else f"{k}={v}" for k, v in e.items()) + ">")
        columns = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"]
        return [*out, "\t".join(columns + (["FORMAT", *self.samples] if self.samples else []))]


def read_header(spark: SparkSession, path: str) -> Header:
    """Header lines come first in a file (of a folder, in its first one): it is read up to the first record."""
    return Header.parse(splits.head(spark, path))


def read_vcf(spark: SparkSession, path: str, samples: list[str] | None = None, split_bytes: int = splits.SPLIT_BYTES) -> tuple[DataFrame, Header]:
    """(records, header). Columns: FIXED, and genotypes map<sample, map<key, value>> of the samples asked for (all, if None).

    Files may be plain, blocked gzip (read in ranges of split_bytes), gzip, bzip2 or compress, whatever their names.
    """
    header = read_header(spark, path)
    body = tables.text(spark, path, split_bytes).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    return parse_records(body, header.samples, samples), header


def parse_records(lines: DataFrame, all_samples: list[str], samples: list[str] | None = None, value: str = "value") -> DataFrame:
    # Beyond the last sample asked for, a line isn't split.
    last = max([9 + all_samples.index(s) for s in (samples if samples is not None else all_samples) if s in all_samples], default=8)
    f = F.split(value, "\t", last + 2)
    part = lambda i: F.get(f, F.lit(i))
    absent = lambda c: F.when(c == ".", F.lit(None)).otherwise(c)
    listed = lambda c, sep: F.when((c == ".") | (c == ""), F.array().cast("array<string>")).otherwise(F.split(c, sep))
    wanted = [s for s in (samples if samples is not None else all_samples) if s in all_samples]
    keys = F.split(part(8), ":")

    def genotype(sample: str) -> Column:
        values = F.split(part(9 + all_samples.index(sample)), ":")
        n = F.size(keys)
        padded = F.slice(F.concat(values, F.array_repeat(F.lit(None).cast("string"), n)), F.lit(1), n)
        return F.map_from_arrays(keys, padded)

    none = F.lit(None).cast("map<string,map<string,string>>")
    genotypes = F.when(F.size(f) > 9, F.create_map(*[x for s in wanted for x in (F.lit(s), genotype(s))])) if wanted else none
    return lines.select(
        part(0).alias("chrom"),
        part(1).try_cast("int").alias("pos"),
        listed(part(2), ";").alias("id"),
        F.upper(F.trim(part(3))).alias("ref"),
        listed(F.upper(F.trim(part(4))), ",").alias("alt"),
        absent(part(5)).try_cast("double").alias("qual"),
        listed(part(6), ";").alias("filter"),
        parse_info(part(7)).alias("info"),
        genotypes.cast("map<string,map<string,string>>").alias("genotypes"),
    )


def parse_info(text: Column) -> Column:
    """map<key, value>; flags have null values; of keys that repeat the last counts; a value may hold '='."""
    pairs = F.transform(F.filter(F.split(text, ";"), lambda p: (p != "") & (p != ".")), lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).alias("v")))

    # Sorted, keys that repeat are neighbours, the last in the text last.
    def last(p: Column) -> Column:
        kept = F.filter(p, lambda x, i: F.coalesce(F.get(p, i + 1)["k"] != x["k"], F.lit(True)))
        return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["k"], x["v"])))

    return F.get(F.transform(F.array(F.array_sort(pairs)), last), F.lit(0))


def typed_info(records: DataFrame, header: Header, prefix: str = "info_") -> DataFrame:
    """A typed column for each INFO id of the header: scalars for Number 0 and 1, arrays for others. Text that doesn't parse is null."""
    columns = {}
    for ident, e in header.meta.get("INFO", {}).items():
        kind, raw = _TYPES.get(e.get("Type", "String"), T.StringType()), F.try_element_at("info", F.lit(ident))
        if isinstance(kind, T.BooleanType):
            col = F.map_contains_key("info", ident)
        elif e.get("Number") == "1":
            col = raw.try_cast(kind)
        else:
            col = F.transform(F.split(raw, ","), _caster(kind))
        columns[prefix + re.sub(r"\W", "_", ident)] = col
    return records.withColumns(columns)


def typed_format(records: DataFrame, header: Header, sample: str, prefix: str = "") -> DataFrame:
    """A typed column for each FORMAT id of the header, of one sample: scalars for Number 1, arrays for others; GT stays text."""
    columns = {}
    for ident, e in header.meta.get("FORMAT", {}).items():
        kind, raw = _TYPES.get(e.get("Type", "String"), T.StringType()), F.try_element_at(F.try_element_at("genotypes", F.lit(sample)), F.lit(ident))
        columns[prefix + re.sub(r"\W", "_", ident)] = raw.try_cast(kind) if e.get("Number") == "1" else F.transform(F.split(raw, ","), _caster(kind))
    return records.withColumns(columns)


def info_table(spark: SparkSession, header: Header) -> DataFrame:
    rows = [(i, e.get("Type"), e.get("Number"), e.get("Description")) for i, e in header.meta.get("INFO", {}).items()]
    return spark.createDataFrame(rows, "id string, type string, count string, description string")


def number_matches(values: Column, number: str, n_alt: Column) -> Column:
    """Strict mode: whether an INFO value has as many parts as its header says."""
    n = F.size(F.split(values, ","))
    wanted = {"A": n_alt, "G": ((n_alt + 1) * (n_alt + 2) / 2).cast("int"), "R": n_alt + 1}.get(number)
    return F.lit(True) if number == "." else n == (wanted if wanted is not None else F.lit(int(number)))


def explode_alts(records: DataFrame) -> DataFrame:
    """One row per alternative allele: alt becomes a string, alt_no counts from 1."""
    return records.select(*[c for c in records.columns if c != "alt"], F.posexplode("alt").alias("_i", "alt")).withColumn("alt_no", F.col("_i") + 1).drop("_i")


def long_genotypes(records: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sample, key, value), a row for each genotype field.

    Entries are exploded and not the maps: of a column that is exploded as it is Spark infers a filter, which parses each record over again.
    """
    d = records.select(*keys, F.explode(F.map_entries("genotypes")).alias("_s"))
    d = d.select(*keys, F.col("_s.key").alias("sample"), F.explode(F.map_entries("_s.value")).alias("_g"))
    return d.select(*keys, "sample", F.col("_g.key").alias("key"), F.col("_g.value").alias("value"))


def add_info(info: Column, key: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(info, lambda k, _: k != key), F.create_map(F.lit(key), value.cast("string")))


def delete_info(info: Column, keys: list[str]) -> Column:
    return F.map_filter(info, lambda k, _: ~k.isin(keys))


def format_records(records: DataFrame, samples: list[str]) -> DataFrame:
    """(value): VCF lines. INFO keys are sorted, GT comes first in genotypes, missing fields are '.'."""
    dot = lambda c: F.when(c.isNull() | (c == ""), ".").otherwise(c)
    joined = lambda c, sep: dot(F.array_join(c, sep))
    entries = F.transform(F.array_sort(F.map_entries("info")), lambda e: F.when(e["value"].isNull(), e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"])))
    qual = F.when(F.col("qual").isNull() | (F.col("qual") == 0), ".").otherwise(F.regexp_replace(F.col("qual").cast("string"), r"\.0$", ""))
    parts = [F.col("chrom"), F.col("pos").cast("string"), joined("id", ";"), F.col("ref"), joined("alt", ","), qual, joined("filter", ";"), joined(entries, ";")]
    if samples:
        first = F.try_element_at("genotypes", F.lit(samples[0]))
        keys = F.array_sort(F.map_keys(first), lambda a, b: F.when(a == b, 0).when(a == "GT", -1).when(b == "GT", 1).when(a < b, -1).otherwise(1))
        parts.append(F.array_join(keys, ":"))
        for s in samples:
            parts.append(F.array_join(F.transform(keys, _looker(F.try_element_at("genotypes", F.lit(s)))), ":"))
    return records.select(F.concat_ws("\t", *parts).alias("value"))


def write_vcf(records: DataFrame, header: Header, path: str) -> None:
    """A folder of text files in order of position: part 0 begins with the header. Ranges of positions are written in parallel."""
    spark = records.sparkSession
    body = format_records(records.orderBy("chrom", "pos"), header.samples).withColumn("_o", F.lit(1))
    head = spark.createDataFrame([(line, 0) for line in header.lines()], "value string, _o int").coalesce(1)
    head.union(body).select("value").write.text(path)

"""Small public vocabularies that come with the library, and how they are loaded.

Each has a declared type and a key.  A vocabulary is checked when it is loaded
and replaces the one that was there as a whole.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VocabularyError(ValueError):
    """A vocabulary whose keys are missing or occur twice."""


@dataclass(frozen=True)
class Vocabulary:
    name: str
    schema: str
    key: tuple[str, ...]
    rows: tuple[tuple, ...]


# Public codes of Brazilian regions and states, and of health forms.
REGIONS = ((1, "Norte"), (2, "Nordeste"), (3, "Sudeste"), (4, "Sul"), (5, "Centro-Oeste"))
STATES = (
    (11, "RO", "Rondônia"), (12, "AC", "Acre"), (13, "AM", "Amazonas"), (14, "RR", "Roraima"), (15, "PA", "Pará"), (16, "AP", "Amapá"), (17, "TO", "Tocantins"),
    (21, "MA", "Maranhão"), (22, "PI", "Piauí"), (23, "CE", "Ceará"), (24, "RN", "Rio Grande do Norte"), (25, "PB", "Paraíba"), (26, "PE", "Pernambuco"), (27, "AL", "Alagoas"), (28, "SE", "Sergipe"), (29, "BA", "Bahia"),
    (31, "MG", "Minas Gerais"), (32, "ES", "Espírito Santo"), (33, "RJ", "Rio de Janeiro"), (35, "SP", "São Paulo"),
    (41, "PR", "Paraná"), (42, "SC", "Santa Catarina"), (43, "RS", "Rio Grande do Sul"),
    (50, "MS", "Mato Grosso do Sul"), (51, "MT", "Mato Grosso"), (52, "GO", "Goiás"), (53, "DF", "Distrito Federal"),
)
MONTHS = ("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")
RACES = (("1", "Branca"), ("2", "Preta"), ("3", "Amarela"), ("4", "Parda"), ("5", "Indígena"), ("9", "Ignorado"))
SEXES = (("1", "Masculino"), ("2", "Feminino"), ("9", "Ignorado"))

PACKAGED = (
    Vocabulary("voc_region", "code int, label string", ("code",), REGIONS),
    Vocabulary("voc_state", "code int, state string, label string, region int", ("code",), tuple((c, s, n, c // 10) for c, s, n in STATES)),
    Vocabulary("voc_month", "code int, label string", ("code",), tuple(enumerate(MONTHS, start=1))),
    Vocabulary("voc_race", "code string, label string", ("code",), RACES),
    Vocabulary("voc_sex", "code string, label string", ("code",), SEXES),
)


def frame(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    return spark.createDataFrame(list(vocabulary.rows), vocabulary.schema)


def check_keys(df: DataFrame, key: tuple[str, ...], name: str) -> None:
    """Refuses missing keys and keys that occur twice, by one aggregate; one such key is said."""
    bad = df.groupBy(*key).agg(F.count("*").alias("_n")).where((F.col("_n") > 1) | F.greatest(*(F.col(c).isNull() for c in key), F.lit(False)))
    for r in bad.limit(1).collect():
        raise VocabularyError(f"{name}: {'no key' if None in r[:-1] else 'twice'}: {tuple(r)[:-1]}")


def load(spark: SparkSession, folder: str, vocabularies: tuple[Vocabulary, ...] = PACKAGED) -> dict[str, int]:
    """Writes vocabularies as Parquet under a folder; returns rows by name.

    All are checked before the first is written.  Each is written beside its
    place and then takes it, so readers see all of the old one or of the new one.
    """
    frames = {v.name: frame(spark, v) for v in vocabularies}
    if len(frames) < len(vocabularies):
        raise VocabularyError("two vocabularies have one name")
    for v in vocabularies:
        check_keys(frames[v.name], v.key, v.name)
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    for name, df in frames.items():
        new, place = path(f"{folder}/.{name}-{uuid.uuid4().hex}"), path(f"{folder}/{name}")
        df.coalesce(1).write.parquet(str(new))
        store = place.getFileSystem(conf)
        store.delete(place, True)
        if not store.rename(new, place):
            raise OSError(f"{name} can't be written")
    return {v.name: len(v.rows) for v in vocabularies}


def read(spark: SparkSession, folder: str, name: str, vocabularies: tuple[Vocabulary, ...] = PACKAGED) -> DataFrame:
    """A loaded vocabulary, with the declared types."""
    found = {v.name: v for v in vocabularies}
    if name not in found:
        raise LookupError(f"no vocabulary {name!r}")
    return spark.read.schema(found[name].schema).parquet(f"{folder}/{name}")

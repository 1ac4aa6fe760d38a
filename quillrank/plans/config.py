"""Settings of an installation: folders, model and year.

They are read from the session (quillrank.*), then from the environment, then
from the defaults. Relative folders are anchored to a root, not to the working
directory of whichever process asks.
"""

from __future__ import annotations

import datetime
import os
from dataclasses import dataclass

from pyspark.sql import SparkSession

#: Setting, environment variable and default.
KEYS = {
    "cvs_dir": ("quillrank.cvs.dir", "CVS_DIR", "cvs"),
    "offers_dir": ("quillrank.offers.dir", "OFERTAS_DIR", "ofertas"),
    "model": ("quillrank.embedding.model", "EMBEDDING_MODEL", "hashed"),
    "vocabulary": ("quillrank.vocabulary", "QUILLRANK_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.json"),
    "database": ("quillrank.database", "QUILLRANK_DATABASE", "default"),
    "this_year": ("quillrank.this.year", "QUILLRANK_YEAR", ""),
}


@dataclass(frozen=True)
class Settings:
    cvs_dir: str
    offers_dir: str
    model: str
    database: str
    this_year: int
    vocabulary: str


def anchored(path: str, root: str) -> str:
    """The path itself if it is absolute or names a store, else below the root."""
    path = os.path.expanduser(path)
    if "://" in path or os.path.isabs(path):
        return path
    return f"{root.rstrip('/')}/{os.path.normpath(path)}"


def settings(spark: SparkSession, root: str) -> Settings:
    def get(name: str) -> str:
        key, variable, default = KEYS[name]
        return spark.conf.get(key, None) or os.environ.get(variable) or default

    year = get("this_year")
    return Settings(anchored(get("cvs_dir"), root), anchored(get("offers_dir"), root), get("model"), get("database"), int(year) if year else datetime.date.today().year, anchored(get("vocabulary"), root))

"""Token counts from a digest cache.

The cache is a table of (tokenizer digest, content digest, tokens), in a folder
that outlives the run.  Texts are digested, one text of each digest is kept
(copies in a task combine before the shuffle), those whose digest the cache has
are dropped, the rest are encoded whole and appended, and every row then takes
its count by its digest.  The ``FREQUENT`` commonest digests reach the rows by
broadcast, so that no text that a third of all rows hold meets in one task; all
others are joined by a shuffle.  The tokenizer digest covers the file and the
library's version, so another tokenizer never finds these counts.

The normal form of a content is its UTF-8 bytes with null as the empty text:
nothing that could change a count is folded.

Defined cases: null and empty texts have 0 tokens; a very long text is encoded
whole; ties (equal texts) have equal counts; repeated rows and other ids
with equal texts are encoded once; an empty table appends nothing; a cache
folder that doesn't exist yet is an empty cache; if two runs append one digest,
the rows agree and count once; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import materialize, slices
from pagemill.llm.tokens import shared

CACHE = "digest binary, n_tokens long"
#: Digests whose counts are sent to every task: about 50 bytes each.
FREQUENT = 1000


def tokenizer_digest(path: str) -> str:
    """Digest of the tokenizer file and the library that reads it."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"tokenizers {tokenizers.__version__}".encode()).hexdigest()


def _cached(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.schema(CACHE).parquet(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e.getCondition()):
            return None
        raise


def _encode(tokenizer: str):
    def run(batches):
        for b in batches:
            for part in slices(b, "text"):
                n = np.diff(shared(tokenizer).ids(part.column("text"))[1])
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, cache: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row; misses are appended to ``cache``."""
    spark = docs.sparkSession
    folder = f"{cache}/{tokenizer_digest(tokenizer)}"
    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(text, 256)).alias("digest")
    rows = materialize(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), digest), "digests")
    misses = docs.select(digest, text.alias("text")).dropDuplicates(["digest"])
    old = _cached(spark, folder)
    if old is not None:
        misses = misses.join(old.select("digest"), "digest", "left_anti")
    misses.mapInArrow(_encode(tokenizer), CACHE).write.mode("append").parquet(folder)

    counts = spark.read.schema(CACHE).parquet(folder).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    common = rows.groupBy("digest").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "digest").limit(FREQUENT).select("digest")
    common = F.broadcast(counts.join(F.broadcast(common), "digest", "left_semi").select("digest", F.col("n_tokens").alias("known")))
    here = rows.join(common, "digest", "left")
    rest = here.where("known IS NULL").join(counts, "digest")
    return here.where("known IS NOT NULL").select("doc_id", "n_bytes", F.col("known").alias("n_tokens")).union(rest.select("doc_id", "n_bytes", "n_tokens"))

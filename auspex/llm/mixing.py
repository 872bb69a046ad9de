r"""Mixing sources to target weights by weighted fair queueing.

The documents of a source are shuffled by a hash and queue in that order, again
and again (``MAX_REPEATS`` times at most).  A queued document's virtual finish
time is the cumulative words of its source, itself included, divided by the
source's target.  Documents that start before time 1, when all targets are met,
are eligible (as in worst-case fair queueing); the one of each source that is in
service then is sent in up to ``PACKETS`` packets with finish times of their own.
All are range-sorted by finish time, and the sequence is truncated where its
cumulative words reach the total budget, inside of a packet if need be.

A source may hold a third of all rows, so no window spans a source: queues and
the sequence are running sums over range-sorted rows (``rows.running_sum``).

Defined cases: null texts and empty texts have size 0 and are taken 0 words; a
very long text is one packet as long as it isn't cut; a null source is a source,
the last one; rows with one doc_id are separate documents, and equal rows queue one
behind the other; an empty table gives an empty mix.  Extra columns are carried,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from auspex.llm.rows import identity, own_names, running_sum
from auspex.sources.shared import join_keyed, materialize

MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
SEED = 20240229
#: Packets of a document that is in service when the budget ends.
PACKETS = 256
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Not null, and in the order of sources: by code point, null last."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("~"))


def targets(sizes: DataFrame) -> DataFrame:
    """``sizes`` (_s, source_size, one row a source) with weight and target.

    Water filling: target = weight * level, but MAX_REPEATS * source_size at most.
    A source that is full leaves its excess to the others, whose level rises; as only
    fuller sources can be added, the rounds end, mostly after two or three.
    """
    ranked = running_sum(sizes.withColumn("_one", F.lit(1).cast("long")), ["_s"], "_one", "_rank").drop("_one")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("_rank") % len(WEIGHTS) + 1).cast("int"))
    w = materialize(ranked.withColumn("weight", weight).withColumn("most", MAX_REPEATS * F.col("source_size")).drop("_rank"), "mix-sources")
    budget = w.agg(F.sum("source_size")).first()[0] or 0
    level, n_full = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= F.col("most")
        now = w.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("most")).otherwise(0)).alias("words"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("rest")).first()
        if now["n"] == n_full or not now["rest"]:
            break
        level, n_full = (budget - now["words"]) / now["rest"], now["n"]
    share = F.col("weight") * F.lit(float(level or 0.0))
    return w.withColumn("target", F.when(share < F.col("most"), share).otherwise(F.col("most").cast("double")))


def queue(docs: DataFrame) -> DataFrame:
    """Distinct rows of ``docs`` (doc_id, source, size, _k: the row's identity) with their number ``n``, source_size, weight, target, and ``before``: the words ahead in the source."""
    items = docs.groupBy("doc_id", "source", "size", "_k").agg(F.count("*").alias("n")).withColumn("_s", source_key(F.col("source")))
    items = items.withColumn("_h", F.xxhash64(F.lit(SEED), "_k")).withColumn("_words", F.col("size") * F.col("n"))
    placed = running_sum(items, ["_s", "_h", "_k", "doc_id", "size"], "_words", "_at")
    sizes = placed.groupBy("_s").agg(F.sum("_words").alias("source_size"), F.min("_at").alias("_base"), F.count("*").alias("_rows"))
    dims = targets(materialize(sizes, "mix-sizes"))
    joined = join_keyed(placed, dims, "_s", "_rows")
    return joined.withColumn("before", F.col("_at") - F.col("_base")).drop("_h", "_words", "_at", "_base", "_rows", "most")


def sequence(queued: DataFrame) -> DataFrame:
    """The packets that the mix takes: rows of ``queued`` with nth (among equals), epoch, finish and ``words``, in the order of finish times and up to the budget.

    ``queued`` has a row for each distinct document.
    """
    rows = queued.where((F.col("size") > 0) & (F.col("target") > 0)).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    rows = rows.withColumn("epoch", F.explode(F.array(*(F.lit(k) for k in range(MAX_REPEATS))))).withColumn("_ahead", F.col("before") + F.col("nth") * F.col("size") + F.col("epoch") * F.col("source_size"))
    eligible = rows.where(F.col("_ahead") < F.col("target"))
    step = F.when(F.col("_ahead") + F.col("size") > F.col("target"), F.ceil(F.col("size") / PACKETS)).otherwise(F.col("size")).cast("long")
    sent = eligible.withColumn("_step", step).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.col("_step")))).withColumn("words", F.least("_step", F.col("size") - F.col("_from")))
    sent = sent.withColumn("finish", (F.col("_ahead") + F.col("_from") + F.col("words")) / F.col("target"))
    line = running_sum(sent.drop("_ahead", "_step", "before", "n"), ["finish", "_s", "_k", "nth", "epoch", "_from"], "words", "_spent")
    budget = queued.agg(F.sum(F.col("size") * F.col("n"))).first()[0] or 0
    return line.where(F.col("_spent") < budget).withColumn("words", F.least("words", F.lit(budget) - F.col("_spent"))).drop("_spent")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix of whole documents, with the columns of ``docs`` (doc_id, source, text, n_chars, any more), in the order of finish times.

    A document has a row for each time it is taken.  Where the cut falls inside a
    document, its row has the words taken, joined by spaces, and n_chars of them.
    """
    own = own_names(docs)
    doc_id, source, text = (F.col(f"`{own[c]}`") for c in ("doc_id", "source", "text"))
    keyed = docs.withColumnsRenamed(own).withColumn("_k", identity(doc_id, source, text))
    queued = queue(keyed.select(doc_id.alias("doc_id"), source.alias("source"), n_words(text).alias("size"), "_k"))
    taken = sequence(queued).groupBy("_k", "nth", "epoch", "size").agg(F.sum("words").alias("words"), F.max("finish").alias("finish"))
    nth = F.row_number().over(Win.partitionBy("_k").orderBy("_k")) - 1
    met = keyed.withColumn("nth", nth.cast("long")).join(taken, ["_k", "nth"])
    order = ["finish", "_k", "nth", "epoch"]
    placed = met.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, F.col("words").cast("int")), " ")
    whole = F.col("words") == F.col("size")
    out = {c: F.col(f"`{name}`") for c, name in own.items()}
    out["text"] = F.when(whole, text).otherwise(cut)
    if "n_chars" in out:
        out["n_chars"] = F.when(whole, out["n_chars"]).otherwise(F.length(cut)).cast(docs.schema["n_chars"].dataType)
    return placed.select(*(v.alias(c) for c, v in out.items()))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", n_words(F.col("text")).alias("size"), identity("doc_id", "source", "text").alias("_k"))
    queued = queue(docs)
    key = ["doc_id", "source", "_k", "nth", "size", "source_size", "target"]
    none = queued.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select(*key, F.lit(0).cast("long").alias("words"))
    return none.unionByName(sequence(queued).select(*key, "words")).groupBy(key).agg(F.sum("words").alias("taken")).select("doc_id", "size", "source_size", "target", "taken", "source")

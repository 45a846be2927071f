"""Exact Jaccard join on word shingles with adaptive multi-match prefixes.

If two sets overlap enough to link, then under any common order of tokens their first |x| - ceil(t |x|) + m tokens
share m or more. With m = 1 this is the plain prefix filter. A longer prefix costs more tokens but asks for more shared
ones, so each document takes the m whose tokens and estimated candidates cost least, and a pair needs min(m_x, m_y)
shared prefix tokens before it is verified.

The join runs in five steps, each over whole tables:

1. ``signatures``: equal sets fall together; tokens that are frequent in some batch are noted as an estimate of cost.
2. ``survivors``: prefix tokens (frequent ones last) meet by token; sets whose prefix shares too little with all
   others drop out.
3. ``shared_tokens``: the survivors' tokens are counted exactly. A set in which fewer than ceil(t |x|) tokens stand in
   another survivor links with nothing. Tokens of one set only come first in the order and are not passed on.
4. Stars: in each token's group every member is compared with one leader, the one with the fewest tokens of its own.
5. The rest: of the pairs that share prefix tokens, only those that stars have not joined are compared.

No group of copies is expanded into its pairs, and no link between different sets is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_bytes, written
from tidemark.llm.components import components

#: Words whose hashes a task keeps.
KEPT_WORDS = 400_000
#: Frequent tokens noted in a batch, the share of a batch's documents that makes a token frequent, and tokens noted in all.
#: They steer order and cost alone; no result depends on them.
BATCH_TOKENS, FREQUENT, NOTED = 2_048, 0.005, 65_536
#: Every set asks for 1 + |x| // FLOOR shared tokens at least in step 2, or for one of these multiples.
FLOOR, MULTIPLES = 24, (1.0, 1.5, 2.0, 3.0)
#: Shares of a set from which step 4 takes the shared tokens to ask for.
LADDER = (0.0, 1 / 64, 1 / 32, 1 / 16, 1 / 8)
#: Costs against passing on one prefix token: of a shared token in the join, and of a candidate's verification per token of its set.
JOINED, VERIFY = 2.0, 0.06
#: Expected documents that share a token that is not noted.
RARE = 0.15


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = value = xxhash.xxh3_64_intdigest(word) >> 1
        return value


def _sets(texts, hashes: _Hashes, width: int):
    """For each text its distinct shingles as a sorted array, or None if it has no words."""
    import numpy as np

    if len(hashes) > KEPT_WORDS:
        hashes.clear()
    for text in texts:
        words = text.lower().split() if text else ()
        if not words:
            yield None
            continue
        code = np.fromiter(map(hashes.__getitem__, words), dtype=np.int64, count=len(words)).view(np.uint64)
        size = min(width, len(words))
        with np.errstate(over="ignore"):
            mixed = np.full(len(words) - size + 1, size, dtype=np.uint64)
            for i in range(size):
                mixed = (mixed ^ code[i : len(words) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
        yield np.unique(mixed.view(np.int64))


def _signature(tokens) -> bytes:
    import hashlib

    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """A row per document (doc_id, sig, n; sig null without words), and rows of noted tokens (token, docs)."""
    doc_type = docs.schema["doc_id"].dataType

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        hashes = _Hashes()
        for batch in batches:
            sigs, sizes, every = [], [], []
            for tokens in _sets(text_bytes(batch), hashes, width):
                sigs.append(None if tokens is None else _signature(tokens))
                sizes.append(0 if tokens is None else len(tokens))
                if tokens is not None:
                    every.append(tokens)
            ids = batch.column(0)
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64()), none, none], names=["doc_id", "sig", "n", "token", "docs"])
            if every:
                found, count = np.unique(np.concatenate(every), return_counts=True)
                often = np.flatnonzero(count >= max(4, FREQUENT * len(every)))
                often = often[np.argsort(-count[often], kind="stable")][:BATCH_TOKENS]
                none = lambda kind: pa.nulls(len(often), kind)
                yield pa.RecordBatch.from_arrays(
                    [none(ids.type), none(pa.binary()), none(pa.int64()), pa.array(found[often]), pa.array(count[often].astype(np.int64))], names=["doc_id", "sig", "n", "token", "docs"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_type.simpleString()}, sig binary, n long, token long, docs long")


def _noted(rows: DataFrame) -> tuple:
    """Noted tokens in order and their estimated documents, as arrays of a bounded size."""
    import numpy as np

    top = rows.where("token IS NOT NULL").groupBy("token").agg(F.sum("docs").alias("docs")).orderBy(F.desc("docs"), "token").limit(NOTED).collect()
    pairs = sorted((r["token"], r["docs"]) for r in top)
    return np.array([p[0] for p in pairs], dtype=np.int64), np.array([p[1] for p in pairs], dtype=np.float64)


def floor_matches(n: int, percent: int) -> int:
    """The least number of shared prefix tokens that any set linked with one of n tokens may ask for."""
    return 1 + (-(-percent * n // 100)) // FLOOR


def prefix_choice(n: int, unlinked: int, costs, choices: list[int]) -> int:
    """The number of shared tokens to ask for: the choice with the least cost of tokens and candidates.

    costs[i] is the estimated number of other documents that share one of the first i tokens.
    """
    best, least = choices[0], None
    for m in choices:
        length = min(n, unlinked + m)
        cost = length + (JOINED + VERIFY * n / m) * costs[length]
        if least is None or cost < least:
            best, least = m, cost
    return best


def survivors(docs: DataFrame, noted: tuple, width: int, percent: int) -> DataFrame:
    """(sig): sets whose prefix shares as many tokens with other sets as a link needs."""
    held = docs.sparkSession.sparkContext.broadcast(noted)

    def prefixes(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        hashes, (known, weight) = _Hashes(), held.value
        for batch in batches:
            tokens_out, sig_out, need_out, sizes = [], [], [], []
            for tokens in _sets(text_bytes(batch), hashes, width):
                if tokens is None:
                    continue
                n, sig = len(tokens), _signature(tokens)
                cost = np.full(n, RARE)
                if len(known):
                    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                    often = np.flatnonzero(known[at] == tokens)
                    if len(often):
                        cost[often] = weight[at[often]]
                        order = np.argsort(cost, kind="stable")
                        tokens, cost = tokens[order], cost[order]
                unlinked = n - -(-percent * n // 100)
                base = 1 + n // FLOOR
                upto = np.concatenate([[0.0], np.cumsum(cost)])
                m = prefix_choice(n, unlinked, upto, sorted({max(1, int(base * x)) for x in MULTIPLES if int(base * x) <= n - unlinked} or {1}))
                tokens_out.append(tokens[: min(n, unlinked + m)])
                sizes.append(len(tokens_out[-1]))
                sig_out.append(sig)
                need_out.append(min(m, floor_matches(n, percent)))
            if tokens_out:
                repeat = np.repeat(np.arange(len(sizes)), sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens_out)), pa.array(sig_out, pa.binary()).take(pa.array(repeat)), pa.array(np.array(need_out, dtype=np.int32)[repeat])], names=["token", "sig", "need"]
                )

    def shared(batches) -> Iterator:
        """Of rows in the order of token and sig, one for each set of a token that stands in several sets."""
        import numpy as np
        import pyarrow as pa

        held_back = None
        first_shared = False
        for batch in batches:
            batch = batch if held_back is None else pa.Table.from_batches([held_back, batch]).combine_chunks().to_batches()[0]
            token = batch.column(0).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=">u8").reshape(-1, 2)
            fresh = np.ones(len(token), dtype=bool)
            same = token[1:] == token[:-1]
            fresh[1:] = ~(same & (sig[1:] == sig[:-1]).all(axis=1))
            places = np.flatnonzero(fresh)
            kept = token[places]
            again = kept[1:] == kept[:-1]
            hit = np.zeros(len(places), dtype=bool)
            hit[1:] |= again
            hit[:-1] |= again
            hit[0] |= first_shared
            # The last set waits for the next batch, with what is known of it.
            out = pa.array(places[:-1][hit[:-1]])
            if len(out):
                yield pa.RecordBatch.from_arrays([batch.column(1).take(out), batch.column(2).take(out)], names=["sig", "need"])
            held_back, first_shared = batch.slice(int(places[-1]), 1), bool(hit[-1])
        if held_back is not None and first_shared:
            yield pa.RecordBatch.from_arrays([held_back.column(1), held_back.column(2)], names=["sig", "need"])

    rows = docs.select("text").mapInArrow(prefixes, "token long, sig binary, need int")
    met = rows.repartition("token").sortWithinPartitions("token", "sig").mapInArrow(shared, "sig binary, need int")
    return met.groupBy("sig").agg(F.count(F.lit(1)).alias("met"), F.max("need").alias("need")).where(F.col("met") >= F.col("need")).select("sig")


def shared_tokens(docs: DataFrame, chosen: DataFrame, width: int, percent: int) -> DataFrame:
    """(sig, n, own, tokens, m): sets that can link, with the tokens that others have, rarest first, and the shared ones to ask for.

    ``chosen`` has (sig, doc_id), a document of each set.
    """

    def sets(batches) -> Iterator:
        import pyarrow as pa

        hashes = _Hashes()
        for batch in batches:
            found = [t for t in _sets(text_bytes(batch), hashes, width) if t is not None]
            yield pa.RecordBatch.from_arrays([pa.array([_signature(t) for t in found], pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["sig", "tokens"])

    ids = chosen.select(F.col("doc_id").alias("__id")).dropDuplicates()
    wanted = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select("text")
    raw = wanted.mapInArrow(sets, "sig binary, tokens array<bigint>").join(chosen.select("sig"), "sig", "left_semi").dropDuplicates(["sig"])
    full = written(raw.select("sig", F.size("tokens").alias("n"), "tokens"), "jaccard-sets")
    each = full.select("sig", "n", F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1")
    listed = each.join(often, "token").groupBy("sig", "n").agg(F.array_sort(F.collect_list(F.struct("docs", "token"))).alias("tokens"))
    able = listed.where(F.size("tokens") >= F.ceil(percent * F.col("n") / 100))

    def choose(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for n, tokens in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                docs = tokens.values.field(0).to_numpy()
                # Costs are those of partners of the same size, the usual ones: with them a pair's prefix is shortest.
                own, unlinked = n - len(docs), n - -(-2 * percent * n // (100 + percent))
                upto = np.concatenate([np.zeros(own + 1), np.cumsum(docs - 1.0)])
                out.append(prefix_choice(n, unlinked, upto, sorted({max(1, int(n * x)) for x in LADDER if int(n * x) <= n - unlinked} or {1})))
            plain = pa.array([t.values.field(1).to_numpy() for t in batch.column(2)], pa.list_(pa.int64()))
            own = pa.array([n - len(t) for n, t in zip(batch.column(1).to_pylist(), plain, strict=True)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), own, plain, pa.array(out, pa.int32())], names=["sig", "n", "own", "tokens", "m"])

    return written(able.mapInArrow(choose, "sig binary, n int, own int, tokens array<bigint>, m int"), "jaccard-able")


def _least_overlap(percent: int):
    return F.ceil(percent * (F.col("n") + F.col("n2")) / (100 + percent))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) whose sets overlap enough."""
    tokens = sets.select("sig", "n", "tokens")
    both = pairs.select("a", "b").join(tokens.withColumnsRenamed({"sig": "a", "tokens": "ta"}), "a").join(tokens.withColumnsRenamed({"sig": "b", "n": "n2", "tokens": "tb"}), "b")
    return both.where(F.size(F.array_intersect("ta", "tb")) >= _least_overlap(percent)).select("a", "b")


def _met(pairs: DataFrame, percent: int):
    """Whether a shared token of (a: n, own, m, place) and (b: n2, own2, m2, place2) counts: it stands in both prefixes that a pair of
    these sizes needs, and the sets may overlap enough."""
    least, m = _least_overlap(percent), F.least("m", "m2")
    fits = F.least(F.col("n") - F.col("own"), F.col("n2") - F.col("own2")) >= least
    return pairs.where(fits & (F.col("place") < F.col("n") - least + m) & (F.col("place2") < F.col("n2") - least + m))


def _candidates(met: DataFrame) -> DataFrame:
    """Pairs that share as many prefix tokens as both ask for."""
    grouped = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.first(F.least("m", "m2")).alias("need"))
    return grouped.where("shared >= need").select("a", "b")


def links(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): verified links that join whatever links join; sets in one class need not all be paired."""
    length = F.least(F.col("n") - F.ceil(percent * F.col("n") / 100) + F.col("m"), F.col("n")) - F.col("own")
    prefix = sets.where(length > 0).select("sig", "n", "own", "m", F.posexplode(F.slice("tokens", F.lit(1), length.cast("int"))).alias("at", "token"))
    rows = written(prefix.select("sig", "n", "own", "m", (F.col("own") + F.col("at")).alias("place"), "token"), "jaccard-prefix")
    second = {"sig": "b", "n": "n2", "own": "own2", "m": "m2", "place": "place2"}
    key = F.struct((F.col("own") / F.col("n")).alias("alone"), *[F.col(x).alias(y) for x, y in second.items()])
    leaders = written(rows.groupBy("token").agg(F.min(key).alias("leader"), F.count(F.lit(1)).alias("members")).where("members > 1").select("token", *[f"leader.{y}" for y in second.values()]), "jaccard-leaders")
    star = _met(rows.withColumnRenamed("sig", "a").join(leaders, "token").where("a <> b"), percent)
    joined = written(_verified(_candidates(star), sets, percent), "jaccard-star")
    found = components(joined)
    # A set without a link yet is a class of its own.
    label = F.coalesce("component", "sig")
    labelled = written(rows.join(found.withColumnRenamed("node", "sig"), "sig", "left").select(*rows.columns, label.alias("class")), "jaccard-classes")
    lead = leaders.select("token", F.col("b").alias("sig")).join(found.withColumnRenamed("node", "sig"), "sig", "left").select("token", label.alias("lead"))
    several = labelled.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("token")
    mixed = labelled.join(several.join(lead, "token"), "token")
    others = mixed.where("class <> lead").select("token", F.col("sig").alias("a"), "n", "own", "m", "place", F.col("class").alias("class1"))
    every = mixed.select("token", *[F.col(x).alias(y) for x, y in second.items()], F.col("class").alias("class2"), (F.col("class") != F.col("lead")).alias("other"))
    # Each pair once: from the side that is not in the leader's class, and if neither is, from the lesser.
    crossing = _met(others.join(every, "token").where((F.col("class1") != F.col("class2")) & (~F.col("other") | (F.col("a") < F.col("b")))), percent)
    ordered = crossing.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "m", "m2")
    rest = written(_verified(_candidates(ordered), sets, percent), "jaccard-rest")
    return joined.unionByName(rest)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the least doc_id that links reach).

    Texts are lower-cased (A-Z) and cut at ASCII white space; a set has the distinct ``width``-word shingles, or the
    whole sequence if there are fewer words. Two documents link when 100 * overlap >= ``percent`` * union. A null text
    or one without words has no shingles and links with nothing. Equal rows and rows sharing a doc_id are documents of
    their own; a null doc_id is never the least unless a class has no other. ``docs`` needs doc_id and text; other
    columns are not read. An empty table gives an empty one.
    """
    rows = written(signatures(docs, width), "jaccard-signatures")
    members = rows.where("token IS NULL").select("doc_id", "sig", "n")
    per_set = written(members.where("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("doc_id")), "jaccard-groups")
    alive = written(survivors(docs, _noted(rows), width, percent), "jaccard-survivors")
    chosen = written(per_set.join(alive, "sig"), "jaccard-chosen")
    sets = shared_tokens(docs, chosen, width, percent)
    classes = components(links(sets, percent)).withColumnsRenamed({"node": "sig", "component": "class"})
    named = written(per_set.join(classes, "sig", "left").select("sig", "doc_id", "class"), "jaccard-named")
    of_class = named.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"))
    component = named.join(of_class, "class", "left").select(F.col("sig").alias("__sig"), F.coalesce("least", "doc_id").alias("component_id"))
    both = members.join(component, F.col("sig") == F.col("__sig"), "left")
    return both.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))

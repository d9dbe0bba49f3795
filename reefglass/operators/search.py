"""Ranked retrieval over three sides of a record: English, Thaana, and Latin letters.

Search is batch-first: a relation of queries becomes a relation of terms (``query_plan``), which meets
the postings; so one query is a batch of one and a batch costs one pass. The postings come from a stored
index (``Index.write`` and ``read``: partitioned by a hash of the word, so that a search reads the
buckets of its words only) or are made on the fly, after the filters. Texts are never moved: only the
words that match leave their partition, and of the documents only the matches are fetched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reefglass import config
from reefglass.checkpoints import cut
from reefglass.functions import lang, scoring
from reefglass.functions.stem import porter, porter_stem
from reefglass.sources.tables import local_table, read_table

MAX_BROADCAST_TERMS, MAX_BROADCAST_MATCHES, BUCKETS = 50_000, 200_000, 64
COLUMNS = (
    "id", "source", "source_key", "doc_type", "url", "title_en", "title_dv", "title_latin", "summary_en", "summary_dv", "price", "currency", "island", "atoll", "published_at", "expires_at",
    "is_active", "attrs", "thumbnails", "category_leaf", "dedupe_key", "quality",
)
#: The English words that a search leaves out.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they
    them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do
    does did doing a an the and but if or because as until while of at by for with about against between into through during before
    after above below to from up down in out on off over under again further then once here there when where why how all any both
    each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)


def documents(spark: SparkSession, data_dir: str, *columns: str) -> DataFrame:
    """search_document, every delivered row once."""
    return read_table(spark, data_dir, "search_document", *(columns or COLUMNS)).dropDuplicates(["id"])


def reposts(docs: DataFrame) -> DataFrame:
    """(id) of the flagged reposts: all but the latest row of a dedupe_key (undated first, then date, id). docs: id, dedupe_key, published_at.

    The survivors are found by one aggregation with map-side combine and taken away by id, so no group meets in one task.
    """
    grouped = docs.where(F.coalesce("dedupe_key", F.lit("")) != "")
    order = F.struct(F.col("published_at").isNull().alias("u"), F.col("published_at").alias("p"), F.col("id").alias("id"))
    survivors = grouped.groupBy("dedupe_key").agg(F.max(order)["id"].alias("id")).select("id")
    return grouped.select("id").distinct().join(survivors, "id", "left_anti")


def weighted_words(title: Column, body: Column, skeleton: bool = False, mode: str = "dual") -> Column:
    """Array of struct(lex, w): title words weigh A, body words B; with skeleton also their consonants.

    Modes: dual (words and skeletons), fili (words only), skeleton (skeletons only, at A and B).
    """
    a, b = lang.tokens(title), lang.tokens(body)

    def weigh(words: Column, w: float, strip: bool) -> Column:
        return F.transform(words, lambda t: F.struct((lang.strip_fili(t) if strip else t).alias("lex"), F.lit(w).alias("w")))

    if not skeleton or mode == "fili":
        return F.concat(weigh(a, config.WEIGHT_A, False), weigh(b, config.WEIGHT_B, False))
    if mode == "skeleton":
        return F.concat(weigh(a, config.WEIGHT_A, True), weigh(b, config.WEIGHT_B, True))
    return F.concat(weigh(a, config.WEIGHT_A, False), weigh(b, config.WEIGHT_B, False), weigh(a, config.WEIGHT_C, True), weigh(b, config.WEIGHT_C, True))


def postings(docs: DataFrame, mode: str = "dual") -> DataFrame:
    """(id, side, lex, w), one row per occurrence."""
    latin = F.when(F.trim(F.coalesce("title_latin", F.lit(""))) != "", F.col("title_latin")).otherwise(lang.translit_dv_to_latin(F.col("title_dv")))
    sides = F.array(
        F.struct(F.lit("en").alias("side"), weighted_words(F.col("title_en"), F.col("summary_en")).alias("words")),
        F.struct(F.lit("dv").alias("side"), weighted_words(F.col("title_dv"), F.col("summary_dv"), True, mode).alias("words")),
        F.struct(F.lit("latin").alias("side"), weighted_words(latin, F.lit("")).alias("words")),
    )
    rows = docs.select("id", F.inline(sides)).select("id", "side", F.inline("words"))
    return rows.where("lex <> ''")


def bucket(lex: Column) -> Column:
    return F.pmod(F.xxhash64(lex), F.lit(BUCKETS)).cast("int")


@dataclass
class Index:
    """postings (side, lex, id, w; w summed per word of a document), words (lex, stem) of the English side, documents with is_duplicate."""

    postings: DataFrame
    words: DataFrame
    documents: DataFrame
    stored: bool = False
    copies: DataFrame | None = None  #: (id, copies) where the postings hold rows delivered twice

    @classmethod
    def of(cls, docs: DataFrame, mode: str = "dual") -> Index:
        """A lazy index; rows delivered twice are in the postings as often."""
        per_row = postings(docs, mode)
        once = docs.dropDuplicates(["id"])
        flagged = reposts(docs.select("id", "dedupe_key", "published_at")).withColumn("is_duplicate", F.lit(True))
        once = once.join(flagged, "id", "left").withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(False)))
        words = per_row.where("side = 'en'").select("lex").distinct().select("lex", porter_stem("lex").alias("stem"))
        return cls(per_row, words, once)

    @classmethod
    def write(cls, docs: DataFrame, path: str, mode: str = "dual") -> None:
        """Stores the index of the documents: postings in BUCKETS folders sorted by word, the dictionary, and the documents by id."""
        docs = docs.dropDuplicates(["id"])
        index = cls.of(docs, mode)
        summed = index.postings.groupBy("side", "lex", "id").agg(F.sum("w").alias("w")).withColumn("bucket", bucket(F.col("lex")))
        # a word of a third of all documents is spread over the tasks that write its bucket
        summed.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("lex", "side").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        index.words.write.mode("overwrite").parquet(f"{path}/words")
        index.documents.write.mode("overwrite").parquet(f"{path}/documents")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "words", "documents")), stored=True)


def query_plan(spark: SparkSession, queries: list[tuple[int, str]], aliases: DataFrame | None = None, translations: DataFrame | None = None) -> DataFrame:
    """(qid, side, lex): the words a query looks for on each side, at most ``TERMS_PER_SIDE`` a side, in the order they arise.

    Quoted phrases are no terms. Thaana words are looked for as they are, as skeletons and in Latin letters;
    words typed on the Latin keyboard are decoded in the case they were typed in, and then the same; words of
    Dhivehi in Latin letters also reach the Thaana side by their spellings; others stay English and Latin.
    aliases (term, expands_to array): curated expansions of the words. translations (source_hash, translation):
    cached translations of whole English queries, which reach the Thaana side.
    """
    q = local_table(spark, queries, qid="int32", q="string").withColumn("q", F.coalesce("q", F.lit("")))
    bare = F.regexp_replace("q", '"[^"]*"', " ")
    pairs = q.select("qid", "q", F.posexplode(F.arrays_zip(lang.tokens(bare).alias("t"), lang.raw_tokens(bare).alias("raw"))).alias("at", "x")).select("qid", "q", "at", "x.t", "x.raw")
    pairs = pairs.withColumn("label", lang.detect_script(F.col("t"))).withColumn("decoded", F.when(F.col("label") == "keys", lang.decode_keys(F.col("raw"))))
    spelled = {(w.lower(), v, i) for _, text in queries for w in (text or "").split() for w in lang.words_of(w) for i, v in enumerate(lang.thaana_variants(w))}
    variants = local_table(spark, sorted(spelled), t="string", variant="string", nth="int32").groupBy("t").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "variant"))), lambda v: v["variant"]).alias("variants"))  # at most 24 a word
    pairs = pairs.join(F.broadcast(variants), "t", "left")

    def entry(side: str, lex: Column, when: Column, step: int) -> Column:
        return F.when(when, F.array(F.struct(F.lit(side).alias("side"), F.lit(step).alias("step"), lex.alias("lex"))))

    dv, keys, phonetic = F.col("label") == "dv", F.col("label") == "keys", F.col("label") == "dv-Latn"
    thaana = F.when(dv, F.col("t")).when(keys, F.col("decoded"))
    entries = [
        entry("dv", thaana, dv | keys, 0), entry("dv", lang.strip_fili(thaana), dv | keys, 1), entry("latin", lang.translit_dv_to_latin(thaana), dv | keys, 0),
        entry("latin", F.col("t"), ~dv & ~keys, 0), entry("en", F.col("t"), ~dv & ~keys, 0),
        F.when(phonetic, F.transform("variants", lambda v, i: F.struct(F.lit("dv").alias("side"), (i + 2).cast("int").alias("step"), v.alias("lex")))),
    ]
    rows = pairs.select("qid", "at", F.inline(F.flatten(F.filter(F.array(*entries), lambda e: e.isNotNull()))))
    later = []
    if aliases is not None:  # active aliases of a word, each text split into words again
        met = pairs.join(aliases.select(F.col("term").alias("t"), F.explode("expands_to").alias("x")), "t").select("qid", "at", F.explode(lang.tokens(F.col("x"))).alias("t"))
        later.append(met.withColumn("at", F.col("at") + 1_000))
    if translations is not None:
        from reefglass.functions import hashes

        english = q.where(query_language(bare) == "en").withColumn("source_hash", hashes.text_key(F.col("q")))
        met = english.join(translations.select("source_hash", "translation"), "source_hash").select("qid", F.posexplode(lang.tokens(F.col("translation"))).alias("at", "t"))
        later.append(met.where(lang.contains_thaana(F.col("t"))).withColumn("at", F.col("at") + 2_000))
    for more in later:
        th = lang.contains_thaana(F.col("t"))
        e = F.array(entry("dv", F.col("t"), th, 0), entry("dv", lang.strip_fili(F.col("t")), th, 1), entry("en", F.col("t"), ~th, 0), entry("latin", F.col("t"), ~th, 0))
        rows = rows.unionByName(more.select("qid", "at", F.inline(F.flatten(F.filter(e, lambda x: x.isNotNull())))))
    first = rows.where("lex <> ''").groupBy("qid", "side", "lex").agg(F.min(F.struct("at", "step")).alias("first"))
    w = Window.partitionBy("qid", "side").orderBy("first", "lex")
    return first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= config.TERMS_PER_SIDE).select("qid", "side", "lex")


def query_terms(spark: SparkSession, queries: list[tuple[int, str]]) -> DataFrame:
    """The plan without aliases and translations."""
    return query_plan(spark, queries)


def english_terms(terms: DataFrame, words: DataFrame) -> DataFrame:
    """The terms with the English ones replaced by every word of the dictionary that has the same stem; stop words are left out.

    A batch of more than MAX_BROADCAST_TERMS English words is joined; of a smaller one the stems go to the scan of the dictionary.
    """
    en = terms.where((F.col("side") == "en") & ~F.col("lex").isin(*STOP_WORDS))
    head = en.limit(MAX_BROADCAST_TERMS + 1).collect()
    if len(head) > MAX_BROADCAST_TERMS:
        stems = en.select("qid", "side", porter_stem("lex").alias("stem")).distinct()
    else:
        rows = sorted({(r.qid, "en", porter(r.lex)) for r in head})
        stems = F.broadcast(local_table(terms.sparkSession, rows, qid="int32", side="string", stem="string"))
        words = words.where(F.col("stem").isin(*sorted({r[2] for r in rows})))
    met = words.join(stems, "stem").select("qid", "side", "lex")
    return terms.where("side <> 'en'").unionByName(met).distinct()


def ranks(post: DataFrame, terms: DataFrame, stored: bool = False) -> DataFrame:
    """(qid, id, r_en, r_dv, r_latin): the sum of the weights of the matched words per side."""
    head = terms.select("qid", "side", "lex", bucket(F.col("lex")).alias("bucket")).limit(MAX_BROADCAST_TERMS + 1).collect()
    if len(head) <= MAX_BROADCAST_TERMS:
        small = local_table(post.sparkSession, [tuple(r[:3]) for r in head], qid="int32", side="string", lex="string")
        if stored:
            wanted = sorted({r.lex for r in head})
            buckets = sorted({r.bucket for r in head})
            post = post.where(F.col("bucket").isin(*buckets) & F.col("lex").isin(*wanted)) if wanted else post.limit(0)
        terms = F.broadcast(small)
    hit = post.join(terms.select("qid", "side", "lex"), ["side", "lex"])
    per = [F.round(F.coalesce(F.sum(F.when(F.col("side") == s, F.col("w"))), F.lit(0.0)), 9).alias(f"r_{s}") for s in ("en", "dv", "latin")]
    return hit.groupBy("qid", "id").agg(*per)


def query_language(q: Column) -> Column:
    return lang.query_script(F.regexp_replace(q, '"[^"]*"', " "))


def response_language(q: Column) -> Column:
    return F.when(query_language(q) == "en", "en").otherwise("dv")


def score(as_of: Column, r: config.Ranking = config.Ranking()) -> Column:  # noqa: B008
    """The blended score over columns r_en, r_dv, r_latin, trg, resp and those of the document."""
    same = F.when(((F.col("resp") == "dv") & (F.col("r_dv") > 0)) | ((F.col("resp") == "en") & (F.col("r_en") > 0)), 1.0).otherwise(0.0)
    late = F.when(F.col("expires_at") < as_of, 1.0).otherwise(0.0)
    return (
        r.w_en * F.col("r_en") + r.w_dv * F.col("r_dv") + r.w_latin * F.col("r_latin") + r.w_trigram * F.col("trg") + r.same_language * same
        + r.freshness * scoring.freshness(F.col("published_at"), F.col("doc_type"), as_of, r) + r.quality * F.coalesce("quality", F.lit(0.0)) - r.expired * late
    )


def candidates(spark: SparkSession, index: Index, queries: list[tuple[int, str]], as_of: str, where: Column | None = None, english: bool = True, aliases: DataFrame | None = None, translations: DataFrame | None = None) -> DataFrame:
    """Every match of the queries among active documents that are no reposts, with its score and parts.

    With ``english`` words meet by their stems and stop words are left out; without, words meet as they are.
    """
    terms = query_plan(spark, queries, aliases, translations)
    if len(queries) * config.TERMS_PER_SIDE * 3 <= MAX_BROADCAST_TERMS:  # planned once
        terms = local_table(spark, [tuple(r) for r in terms.collect()], qid="int32", side="string", lex="string")
    if english:
        terms = english_terms(terms, index.words)
    found = ranks(index.postings, terms, index.stored)
    if index.copies is not None:  # equal copies of a document count once
        found = found.join(index.copies, "id").select("qid", "id", *[F.round(F.col(r) / F.col("copies"), 9).alias(r) for r in ("r_en", "r_dv", "r_latin")])
    found = cut(found)
    if found.limit(MAX_BROADCAST_MATCHES + 1).count() <= MAX_BROADCAST_MATCHES:
        found = F.broadcast(found)
    docs = index.documents.where("is_active and not is_duplicate")
    if where is not None:
        docs = docs.where(where)
    q = local_table(spark, queries, qid="int32", q="string").withColumn("resp", response_language(F.col("q"))).withColumn("q3", lang.trigrams(F.col("q")))
    if len(queries) <= MAX_BROADCAST_TERMS:
        q = F.broadcast(q)
    cand = docs.join(found, "id").join(q, "qid")
    sims = [lang.trigram_similarity(lang.trigrams(F.col(t)), F.col("q3")) for t in ("title_en", "title_dv", "title_latin")]
    cand = cand.withColumn("trg", F.greatest(*sims))
    return cand.withColumn("score", F.round(score(F.lit(as_of).cast("timestamp")), 6)).drop("q3")


def scored_candidates(spark: SparkSession, data_dir: str, queries: list[tuple[int, str]], as_of: str, where: Column | None = None, mode: str = "dual", english: bool = True) -> DataFrame:
    """candidates() without a stored index: the table is read, filtered, and its words are made as they are matched."""
    docs = read_table(spark, data_dir, "search_document", *COLUMNS)
    live = docs.where("is_active")
    if where is not None:
        live = live.where(where)
    index = Index.of(live, mode)
    narrow = read_table(spark, data_dir, "search_document", "id", "dedupe_key", "published_at")
    copies = live.groupBy("id").agg(F.count(F.lit(1)).alias("copies"))
    shown = Index(index.postings, index.words, live.withColumn("is_duplicate", F.lit(False)), copies=copies)
    return candidates(spark, shown, queries, as_of, None, english).dropDuplicates(["qid", "id"]).join(reposts(narrow), "id", "left_anti")


#: Orders of the result page; each is total.
SORTS = {
    "relevance": (("score", "desc"), ("id", "desc")),
    "newest": (("published_at", "desc"), ("id", "desc")),
    "price_asc": (("price", "asc"), ("score", "desc"), ("id", "desc")),
    "price_desc": (("price", "desc"), ("score", "desc"), ("id", "desc")),
    "salary_desc": (("estimated_net_min", "desc"), ("score", "desc"), ("id", "desc")),
    "views_desc": (("views", "desc"), ("score", "desc"), ("id", "desc")),
}


def sort_columns(name: str | None) -> list[Column]:
    """Columns of a named order, nulls last; an unknown name means relevance."""
    return [F.desc_nulls_last(c) if d == "desc" else F.asc_nulls_last(c) for c, d in SORTS.get(name or "", SORTS["relevance"])]


def top_candidates(cand: DataFrame, sort: str | None = None, cap: int = config.CANDIDATE_CAP) -> DataFrame:
    """The best ``cap`` matches per query with their position, and total, their number after the cap."""
    w = Window.partitionBy("qid").orderBy(*sort_columns(sort))
    top = cand.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= cap)
    return top.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("qid")))


def page(top: DataFrame, number: int, size: int) -> DataFrame:
    """One page; numbers start at 1, sizes are clamped to 1..100, past the end it is empty."""
    number, size = max(1, number), min(100, max(1, size))
    return top.where((F.col("pos") > (number - 1) * size) & (F.col("pos") <= number * size))


def interleave(top: DataFrame, group: str, cap: int = config.RUN_CAP) -> DataFrame:
    """Reorders each query's (bounded) candidates so that no group runs longer than ``cap`` while another has rows left."""
    from pyspark.sql import types as T

    def run(pdf):
        queues: dict = {}
        for row in pdf.sort_values("pos").itertuples():
            queues.setdefault(getattr(row, group), []).append((row.score, row.Index))
        order, last, length = [], None, 0
        heads = dict.fromkeys(queues, 0)
        while len(order) < len(pdf):
            open_groups = [g for g in queues if heads[g] < len(queues[g])]
            allowed = [g for g in open_groups if not (g == last and length >= cap)] or open_groups
            pick = max(allowed, key=lambda g: queues[g][heads[g]][0])  # the first of the best
            order.append(queues[pick][heads[pick]][1])
            heads[pick] += 1
            last, length = pick, length + 1 if pick == last else 1
        out = pdf.loc[order].copy()
        out["slot"] = range(1, len(out) + 1)
        return out

    schema = T.StructType([*top.schema.fields, T.StructField("slot", T.IntegerType())])
    return top.groupBy("qid").applyInPandas(run, schema)


def suggest_terms(docs: DataFrame, limit: int = config.SUGGEST_TERMS) -> DataFrame:
    """(term, script, freq, doc_type): words of titles by the number of documents, with their commonest kind."""
    words = F.array_distinct(lang.tokens(F.concat_ws(" ", "title_en", "title_dv", "title_latin")))
    keep = F.filter(words, lambda t: (F.length(t) >= config.SUGGEST_MIN_TERM) & ~t.rlike("^[0-9]+$"))
    per = docs.select("doc_type", F.explode(keep).alias("term")).groupBy("term", "doc_type").agg(F.count(F.lit(1)).alias("n"))
    all_ = per.groupBy("term").agg(F.sum("n").alias("freq"), F.max_by("doc_type", F.struct("n", "doc_type")).alias("doc_type"))
    top = all_.orderBy(F.desc("freq"), "term").limit(limit)
    return top.select("term", F.when(lang.contains_thaana(F.col("term")), "thaana").otherwise("latin").alias("script"), "freq", "doc_type")


def suggest(terms: DataFrame, q: str, limit: int = 10) -> DataFrame:
    """Terms that begin with the query or are similar to it; prefixes first, then similarity, frequency, name."""
    q = (q or "").strip().lower()
    if len(q) < config.SUGGEST_MIN_QUERY:
        return terms.select("term", F.lit(True).alias("is_prefix"), F.lit(0.0).alias("sim"), "freq").limit(0)
    sim = F.round(lang.trigram_similarity(lang.trigrams(F.col("term")), lang.trigrams(F.lit(q))), 6)
    rows = terms.select("term", F.col("term").startswith(q).alias("is_prefix"), sim.alias("sim"), "freq")
    rows = rows.where(F.col("is_prefix") | (F.col("sim") > config.SUGGEST_SIMILARITY))
    return rows.orderBy(F.desc("is_prefix"), F.desc("sim"), F.desc("freq"), "term").limit(min(20, max(1, limit)))

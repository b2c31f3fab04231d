"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from adjudica.llm import chat, cosine, exact_dedup, hamming, language, lexical, line_dedup, metric_join, mixing, near_dedup, packing, quality, token_counts, trie
from adjudica.sources import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def _query(check: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if check is not None:
            CHECKS[run.__name__] = check
        return run

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _held_out(doc_id: str = "doc_id") -> Column:
    """A fifth of the rows by id, never learned from. Rows without an id are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


@_query()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by hyperdimensional profiles learned outside the held-out fifth."""
    docs = _read(spark, sf_dir, "documents")
    prototypes = language.learn(docs.where(~_held_out()))
    found = language.identify(docs, prototypes)
    return found.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")


#: The contract's extra conversation, as a record of another layout than the table's rows.
SEVEN = """{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"},
                {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}"""


@_query(
    r"""
    with t as (
      select conv_id, turn, role, coalesce(text, '') as text from conversations
      union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
      union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), e as (
      select *, length(regexp_replace(replace(text, '\', '\\'), '([<\[])(/?s>|/?INST\]|/?SYS\]|/?ROLE)', '\1\\\2', 'g'))
                + case role when 'user' then 18 when 'system' then 16 when 'assistant' then 9
                  else 19 + length(role) end as chars
      from t
    )
    select conv_id, count(*) as n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
           coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
           sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
           sum(chars)::bigint as formatted_chars
    from e group by conv_id
    """
)
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and its turns and loss text read back from the string."""
    rows = _read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    seven = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit(SEVEN).alias("payload")
    )
    keys = ("conv_id", "turn")
    turns = chat.row_turns(rows, keys).unionByName(chat.canonical_turns(seven, keys=keys))
    done = chat.format_turns(turns, "conv_id", ("turn", "pos"))
    read = done.select(
        "conv_id",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("spans")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


@_query()
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document. The cache starts empty, so that the query's cost is that of a cold run."""
    cache = scratch.new_path(spark, "token-cache")
    token_counts.new_cache(spark, cache)
    return token_counts.count_tokens(
        _read(spark, sf_dir, "documents"),
        tokenizer=public_tokenizers.path("piece_bpe_32k.model"),
        cache=cache,
        limit=4096,
    )


@_query(
    r"""
    with recursive sized as (
      select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size from documents
    ), totals as (
      select source, sum(size)::bigint as source_size from sized group by source
    ), weighed as (
      select *, [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w,
             sum(source_size) over () * 1.5::double as budget
      from totals
    ), filled as (
      -- In each step, sources above twice their size are set to it and the rest is dealt anew.
      select 0 as step, source, source_size, w, budget, false as is_full from weighed
      union all
      select step + 1, source, source_size, w, budget,
             is_full or ((budget - coalesce(sum(case when is_full then 2 * source_size end) over (), 0))
                         / sum(case when not is_full then w end) over ()) * w > 2 * source_size
      from filled where step < (select count(*) from weighed)
    ), targets as (
      select source, source_size,
             case when is_full then (2 * source_size)::double
                  else ((budget - coalesce(sum(case when is_full then 2 * source_size end) over (), 0))
                        / sum(case when not is_full then w end) over ()) * w end as target
      from filled where step = (select count(*) from weighed)
    ), ranked as (
      select s.doc_id, s.size, t.source_size, t.target,
             row_number() over (partition by s.source order by s.size, md5(s.doc_id::varchar), s.doc_id) as k,
             case when t.source_size > 0 then t.target / t.source_size else 0 end as rate,
             ('0x' || substr(md5('mix-1|' || coalesce(s.source, chr(0) || 'null')), 1, 8))::bigint
               / 4294967296::double as u
      from sized s join targets t on s.source is not distinct from t.source
    )
    select doc_id, size, source_size, target,
           (floor(rate * k + u) - floor(rate * (k - 1) + u))::bigint * size as taken
    from ranked
    """
)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    taken = mixing.sample(_read(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


@_query(
    """
    with d as (
      select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
      from documents
    ), g as (
      select doc_id, sha256(t) as text_sha256, max(doc_id) over (partition by t) as keep_id,
             count(*) over (partition by t) as group_size
      from d
    )
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g
    """
)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy that stays, by length, prefix hash and full hash."""
    digest = F.sha2(exact_dedup.normalised(), 256)
    groups = exact_dedup.exact_groups(
        _read(spark, sf_dir, "documents"), carry={"text_sha256": digest}
    )
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@_query(
    """
    with codes as (
      select distinct vec_id as id,
             [coalesce(embedding[j], 0)::double + coalesce(embedding[j + 32], 0)::double > 0 for j in range(1, 33)] as code
      from embeddings where vec_id is not null and embedding is not null
    ), far as (
      select q.id as query_id, q.code as query, c.id, c.code,
             len([1 for b in list_zip(q.code, c.code) if b[1] <> b[2]])::int as distance
      from codes q, codes c where q.id % 100 = 0 and (q.id <> c.id or q.code <> c.code)
    ), ranked as (
      select *, row_number() over (partition by query_id, query order by distance, id, code)::int as rank from far
    )
    select query_id, rank, id as neighbor_id, distance from ranked where rank <= 10
    """
)
def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest codes of every hundredth embedding, among all."""
    codes = scratch.materialise(
        hamming.binary_codes(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "hamming-codes"
    )
    return hamming.nearest(codes, codes.where("id % 100 = 0"))


@_query(
    """
    with v as (
      select distinct vec_id as id, [coalesce(embedding[j], 0)::double for j in range(1, 65)] as e
      from embeddings where vec_id is not null and embedding is not null
    ), near as (
      select q.id as query_id, q.e as query, c.id, list_cosine_similarity(q.e, c.e) as similarity
      from v q, v c where q.id % 100 = 0 and (q.id <> c.id or q.e <> c.e)
    ), ranked as (
      select *, row_number() over (partition by query_id, query order by similarity desc, id)::int as rank from near
    )
    select query_id, rank, id as neighbor_id, similarity from ranked where rank <= 10
    """
)
def op6_topk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors nearest to every hundredth embedding by cosine similarity, among all."""
    vectors = scratch.materialise(
        cosine.dense(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "cosine-vectors"
    )
    return cosine.nearest(vectors, vectors.where("id % 100 = 0"))


@_query()
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their bins."""
    return packing.pack(_read(spark, sf_dir, "documents"))


@_query()
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of lines that occur before it; digests of what is left."""
    cleaned = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))
    return cleaned.select(
        "doc_id",
        "n_lines",
        "removed_lines",
        F.size("runs").cast("long").alias("n_runs"),
        F.length(F.coalesce("clean_text", F.lit(""))).cast("long").alias("clean_chars"),
        F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("clean_sha256"),
    )


@_query()
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near-duplicates."""
    return near_dedup.near_classes(_read(spark, sf_dir, "documents"))


@_query()
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learned from labels outside the held-out fifth."""
    described = scratch.materialise(
        quality.describe(_read(spark, sf_dir, "documents")), "quality-statistics"
    )
    labels = _read(spark, sf_dir, "labels").where(~_held_out()).select("doc_id", F.col("quality").alias("label"))
    model = quality.learn(described.join(labels, "doc_id"))
    return quality.score(described, model).select(
        "doc_id",
        _held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


@_query(
    r"""
    with recursive w as (
      select doc_id, row_number() over () as row,
             regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x20\x09-\x0D]+') as words
      from documents
    ), s as (
      select distinct row, unnest(list_transform(range(1, greatest(len(words) - 4, 1) + 1),
                                                 lambda i: array_to_string(words[i:i + 4], ' '))) as shingle
      from w where len(words) > 0
    ), n as (
      select row, count(*) as n from s group by row
    ), pairs as (
      select a.row as a, b.row as b, count(*) as common
      from s a join s b on a.shingle = b.shingle and a.row <> b.row group by all
    ), links as (
      select a, b from pairs join n x on x.row = a join n y on y.row = b where 100 * common >= 80 * (x.n + y.n - common)
    ), reached as (
      select row as a, row as b from w union select r.a, l.b from reached r join links l on l.a = r.b
    )
    select w.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(o.doc_id) as component_id
    from w left join n using (row) join reached r on r.a = w.row join w o on o.row = r.b
    group by w.row, w.doc_id
    """
)
def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of its shingles and its component of linked documents."""
    return metric_join.linked_classes(_read(spark, sf_dir, "documents"))


_TERMS_SQL = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    + r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)


@_query(
    f"""
    with d as (
      select doc_id, row_number() over () as row, {_TERMS_SQL} as terms from documents
    ), t as (
      select row, unnest(terms) as term from d
    ), tf as (
      select row, term, count(*) as tf from t group by row, term
    ), n as (
      select row, any_value(doc_id) as doc_id, any_value(len(terms))::bigint as n from d where len(terms) > 0 group by row
    ), corpus as (
      select count(*)::bigint as n_docs, sum(n)::bigint as length from n
    ), m as (
      select row, doc_id, 50 + ((50 * n * n_docs) // length)::bigint as m from n, corpus
    ), df as (
      select term, count(*) as df from tf group by term
    ), i as (
      select item_id, row_number() over () as item, {_TERMS_SQL} as terms from benchmark
    ), q as (
      select distinct item_id, item, unnest(terms) as term from i
    ), w as (
      select item_id, item, term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint as w
      from q join df using (term), corpus
    ), scored as (
      select item_id, item, doc_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score
      from w join tf using (term) join m using (row) group by all
    )
    select item_id, row_number() over (partition by item order by score desc, doc_id)::int as rank, doc_id, score
    from scored where score > 0
    qualify rank <= 50
    """
)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    return lexical.rank(_read(spark, sf_dir, "benchmark"), _read(spark, sf_dir, "documents"), k=50)


#: CRC-32 of a decimal number in SQL: the table of the reversed polynomial, then one step per byte.
_CRC_SQL = """
    bits as (
      select i, 0 as step, i::bigint as v from range(256) r(i)
      union all
      select i, step + 1, xor(v >> 1, (v & 1) * 3988292384) from bits where step < 8
    ), crc_table as (
      select list(v order by i) as steps from bits where step = 8
    )
"""


@_query(
    f"""
    with recursive {_CRC_SQL}, t as (
      select conv_id, row_number() over (
               partition by conv_id
               order by turn nulls first, md5(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))
             ) as place,
             md5(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as turn_id,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as words
      from conversations where conv_id is not null
    ), c as (
      select conv_id,
             xor(list_reduce(
               list_prepend(4294967295::bigint, list_transform(range(1, length(conv_id::varchar) + 1),
                                                               lambda i: ord(substr(conv_id::varchar, i, 1))::bigint)),
               lambda crc, b: xor(crc >> 8, steps[(xor(crc, b) & 255) + 1])
             ), 4294967295) % 4 as h
      from (select distinct conv_id from t), crc_table
    ), rebuilt as (
      select c.conv_id, t.place, turn_id, words from c join t on t.conv_id = c.conv_id - c.conv_id % 20 and t.place <= h
      union all
      select c.conv_id, h + t.place, turn_id, words from c join t using (conv_id) where t.place > h
    ), paths as (
      select conv_id, list(turn_id order by place) filter (turn_id is not null) as path, list(words order by place) as words
      from (select conv_id, place, turn_id, words from rebuilt
            union all select conv_id, null, null, null from c where conv_id not in (select conv_id from rebuilt))
      group by conv_id
    ), members as (
      select conv_id, coalesce(path, []) as path, unnest(range(0, coalesce(len(path), 0) + 1)) as depth,
             coalesce(len(path), 0) as length, words
      from paths
    ), nodes as (
      select depth, path[1:depth] as prefix, min(conv_id) as conv_id, count(*) as n_convs,
             case when depth > 0 then any_value(words[depth]) else 0 end as last_words,
             sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (length = depth), '')) as ends_sha256
      from members group by depth, path[1:depth]
    ), linked as (
      select n.*, p.conv_id as parent_conv_id,
             (select count(*) from nodes k where k.depth = n.depth + 1 and k.prefix[1:n.depth] = n.prefix) as n_children
      from nodes n left join nodes p on p.depth = n.depth - 1 and p.prefix = n.prefix[1:n.depth - 1]
    )
    select n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children,
           count(*) filter (s.n_children = 0) as n_leaves,
           sum((s.n_convs - 1) * s.last_words)::bigint as saved_tokens, n.ends_sha256
    from linked n join linked s on s.depth >= n.depth and s.prefix[1:n.depth] = n.prefix
    group by all
    """
)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each rebuilt with the first turns of its group's first one."""
    lists = scratch.materialise(trie.turn_lists(_read(spark, sf_dir, "conversations")), "turn-lists")
    heads = lists.select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("head"))
    shared = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    own = lists.select("*", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), shared.alias("h"))
    rebuilt = own.join(heads, "base", "left").select(
        "conv_id",
        F.concat(
            F.when(F.col("head").isNull(), F.array().cast(lists.schema["turns"].dataType)).otherwise(
                F.slice("head", F.lit(1), F.col("h"))
            ),
            F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))),
        ).alias("turns"),
    )
    return trie.prefix_trie(rebuilt)

"""One query for each operator, over its whole table, and its SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readspan.llm import chat_format, divergence, exact_dedup, html_extract, media, minhash, mixing, packing, prefix_trie, sentencepiece_codec, sharding, substring_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format every conversation and one whose texts are control strings; report what reads back."""
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    back = chat_format.read_chats(chat_format.format_chats(turns))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha(whole).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        sha(F.col("loss_text")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = html_extract.extract_main_text(_table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal whole texts, unchanged; the largest doc_id stays."""
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"), keep="largest")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every whole document, learned from labelled rows that aren't held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and what they decode to."""
    coded = sentencepiece_codec.encode_decode(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), F.length("decoded").cast("long").alias("decoded_chars"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform shuffle of all documents into eight shards of equal row counts."""
    return sharding.shard_rows(_table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a stored image; a page a row shows it between two texts and names it by digest, and the join resolves what was read back.

    Pages are numbered by row, so rows without an id and rows that repeat one have a page each.
    """
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumns({"digest": F.sha2(F.encode("text", "UTF-8"), 256), "page": F.monotonically_increasing_id()})
    features = media.media_features(media.store_media(docs.select("digest", "text"), "digest", "text"))
    shown = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    page = F.concat(F.lit('<p>before</p><figure><img src="digest:'), F.col("digest"), F.lit('"><figcaption>'), shown, F.lit("</figcaption></figure><p>after</p>"))
    pages = media.interleave(media.page_items(docs.select("page", page.alias("html")), "page", "html"), features)
    item = F.element_at("items", 2)  # between its texts
    return pages.select(F.nullif(item["caption"], F.lit("")).cast("long").alias("doc_id"), item["media"].alias("m")).select("doc_id", "m.*")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages that repeat one of another document."""
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ, and in which terms."""
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shared opening of the conversations, rebuilt from their families."""
    return prefix_trie.family_trie(_table(spark, sf_dir, "conversations"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in a mix of one and a half times their words, sources weighing 3, 1 and 2 in turn."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_html_extraction": op2_html_extraction,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_sharding": op7_sharding,
    "op8_media_columns": op8_media_columns,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_source_mixing": op13_source_mixing,
}

ORACLES: dict[str, str] = {
    "op1_chat_format": r"""
        with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as t from conversations
                   union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        f as (select *, coalesce(lag(role) over w = role, false) as before, coalesce(lead(role) over w = role, false) as after,
                len(regexp_extract_all(t, '[<\[]\\*(/?s>|/?INST\]|/?SYS>|<SYS>>|</SYS>>|\|[A-Za-z0-9_]*\|>)')) as escapes
              from c window w as (partition by conv_id order by turn, role, t))
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' order by turn, role, t)) as turns_sha256,
          cast(coalesce(sum(length(t)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
          sha256(coalesce(string_agg(t, '' order by turn, role, t) filter (where role = 'assistant'), '')) as loss_sha256,
          cast(sum(case when before then 11 else 13 + length(role) end + length(t) + escapes + case when after then 0 else 11 end) as bigint) as formatted_chars
        from f group by conv_id
    """,
    "op3_exact_dedup": """
        with d as (select doc_id, coalesce(text, '') as t from documents)
        select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
               doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
        from d
    """,
    "op11_source_divergence": r"""
        with d as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as t, row_number() over () as row from documents),
        w as (select row, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
        kept as (select lang, term, count(*) as total from w group by lang, term having count(distinct row) >= 3),
        g as (select distinct lang, source from d),
        v as (select lang, count(*) as v, sum(total) as n from kept group by lang),
        c as (select lang, source, term, count(*) as c from w group by all),
        n as (select lang, source, sum(c) as n from c join kept using (lang, term) group by all),
        s as (select g.lang, g.source, k.term, coalesce(c.c, 0) as c, k.total, coalesce(n.n, 0) as n, v.v, v.n as nl
              from g join kept k on k.lang = g.lang join v on v.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term left join n on n.lang = g.lang and n.source = g.source),
        p as (select lang, source, term, c, (1 + 1000000000::hugeint * (c + 1) // (n + v))::bigint as p, (1 + 1000000000::hugeint * (total + 1) // (nl + v))::bigint as q from s),
        f as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
        pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0) as value
                 from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
        term as (select lang, source, 'term' as part, term as item, (p - q) * (p - q) // q as value from p where c > 0 and p > q),
        r as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from (select * from pair union all select * from term))
        select lang, source, part, item, value, rank from r where part = 'pair' or rank <= 200
    """,
    "op12_prefix_trie": """
        with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
                     row_number() over (partition by conv_id order by turn nulls first, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as pos
                   from conversations where conv_id is not null),
        c as (select conv_id, conv_id - conv_id % 5 as base,
                xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(cast(conv_id as varchar), ''), lambda x: [cast(ascii(x) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))),
                  lambda a, b: case when b >= 0 then xor(a, b) when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end), 4294967295) % 9 as h
              from (select distinct conv_id from t)),
        r as (select c.conv_id, t.pos, t.role, t.text from c join t on t.conv_id = c.base and t.pos < c.h
              union all select c.conv_id, t.pos + 1000000, t.role, t.text from c join t on t.conv_id = c.conv_id and t.pos >= c.h),
        s as (select conv_id, row_number() over (partition by conv_id order by pos) as depth, strlen(text) as bytes,
                list(struct_pack(role := role, text := text)) over (partition by conv_id order by pos) as path from r),
        m as (select conv_id, 0 as depth, 0 as bytes, cast([] as struct(role varchar, text varchar)[]) as path from c union all select conv_id, depth, bytes, path from s),
        ends as (select path, string_agg(cast(conv_id as varchar), ',' order by conv_id) as ids from (select conv_id, arg_max(path, depth) as path from m group by conv_id) group by path),
        n as (select path, any_value(depth) as depth, any_value(bytes) as bytes, min(conv_id) as conv_id, count(*) as n_convs from m group by path),
        k as (select n.*, (select count(*) from n x where x.depth = n.depth + 1 and x.path[:n.depth] = n.path) as n_children from n),
        sub as (select a.path, count(*) filter (where b.n_children = 0) as n_leaves, sum((b.n_convs - 1) * b.bytes) as saved
                from (select k.*, unnest(range(0, k.depth + 1)) as up from k) b join k a on a.depth = b.up and a.path = b.path[:b.up] group by a.path)
        select k.conv_id, cast(k.depth as bigint) as depth, p.conv_id as parent_conv_id, k.n_convs, k.n_children, sub.n_leaves, cast(sub.saved as bigint) as saved_tokens, sha256(coalesce(ends.ids, '')) as ends_sha256
        from k join sub on sub.path = k.path left join ends on ends.path = k.path left join k p on k.depth > 0 and p.depth = k.depth - 1 and p.path = k.path[:k.depth - 1]
    """,
    "op13_source_mixing": r"""
        with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
        s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rank from d group by source),
        w as (select *, [3, 1, 2][rank % 3 + 1] as weight, 2 * source_size as cap from s),
        l as (select *, (1.5::double * (sum(source_size) over ())::double - (coalesce(sum(cap) over before, 0))::double) / (sum(weight) over () - coalesce(sum(weight) over before, 0))::double as level
              from w window before as (order by cap::double / weight, rank rows between unbounded preceding and 1 preceding)),
        x as (select coalesce(max(level) filter (where level <= cap::double / weight), 1e300) as top from l),
        t as (select source, source_size, rank, least(cap::double, top * weight) as target from l, x),
        g as (select doc_id, size, source_size, target, rank, count(*) as n, (size * count(*))::bigint as words from d join t on d.source is not distinct from t.source where size > 0 group by doc_id, size, source_size, target, rank),
        q as (select *, (sum(words) over (partition by rank order by md5(coalesce(cast(doc_id as varchar), '')), doc_id nulls first, size rows unbounded preceding) - words)::bigint as pos from g),
        e as (select *, unnest(range(0, 2)) as turn from q),
        k as (select *, greatest(1, floor(target / 1000))::bigint as packet, unnest(range(0, words, greatest(1, floor(target / 1000))::bigint)) as lo from e),
        y as (select *, least(lo + packet, words) - lo as length, (turn * source_size + pos + least(lo + packet, words))::double / target as finish from k),
        z as (select *, (sum(length) over (order by finish, rank, turn, pos, lo rows unbounded preceding) - length)::bigint as before, (select floor(sum(source_size) * 1.5)::bigint from s) as budget from y),
        m as (select doc_id, size, n, source_size, target, rank, pos, turn, sum(greatest(0, least(length, budget - before)))::bigint as took, min(before) filter (where turn = 0 and lo = 0 and before < budget) as begins from z group by doc_id, size, n, source_size, target, rank, pos, turn),
        c as (select *, unnest(range(0, n)) as copy from m)
        select doc_id, size, source_size, target, sum(greatest(0, least(size, took - copy * size)))::bigint as taken, case when copy = 0 and sum(greatest(0, least(size, took))) > 0 then min(begins) end as first_at
        from c group by doc_id, size, source_size, target, rank, pos, copy
        union all select doc_id, size, source_size, target, 0, null from d join t on d.source is not distinct from t.source where size = 0
    """,
}

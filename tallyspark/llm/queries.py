"""Registered queries of the training-data operators: each over the whole of its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import align, ann, bpe, collocations, decontam, langid, lm, neardup, pii, topk, toxicity, urls, \
    warc
from tallyspark.llm.common import fold, held_out, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_warc(table(spark, sf_dir, "pages"))
    return warc.read_warc(spark, archive, payloads=False).select("page_id", "payload_bytes", "payload_digest",
                                                                "record_type", "refers_to")


def op2_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                          F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op4_viterbi_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(fold(F.col("doc_id")) != 0))
    return langid.predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm.score(docs, lm.train(docs))


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
             ("block", "net/fr/")]


def op6_bayes_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op8_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_hyperminhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op10_skipchain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                                                F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op11_cyclic_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"), least=100, top=2000)


def op12_merge_path_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents")).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best",
                                                                 "count_sum", "groups_sha256")


def op13_collision_counting_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


QUERIES = {
    "op1_warc": op1_warc,
    "op2_latent_decontamination": op2_latent_decontamination,
    "op3_chunked_bpe": op3_chunked_bpe,
    "op4_viterbi_langid": op4_viterbi_langid,
    "op5_masked_pseudo_likelihood": op5_masked_pseudo_likelihood,
    "op6_bayes_url_filter": op6_bayes_url_filter,
    "op7_maxscore_topk": op7_maxscore_topk,
    "op8_lexicon_toxicity": op8_lexicon_toxicity,
    "op9_hyperminhash_neardup": op9_hyperminhash_neardup,
    "op10_skipchain_pii": op10_skipchain_pii,
    "op11_cyclic_collocations": op11_cyclic_collocations,
    "op12_merge_path_alignment": op12_merge_path_alignment,
    "op13_collision_counting_ann": op13_collision_counting_ann,
}
ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
        with p as (select page_id, coalesce(html, '') html, cast(octet_length(encode(coalesce(html, ''))) as bigint) n,
                          max(page_id) over (partition by coalesce(html, '')) top from pages)
        select page_id, n payload_bytes, sha1(html) payload_digest,
               case when n >= 1000 and page_id <> top then 'revisit' else 'response' end record_type,
               case when n >= 1000 and page_id <> top then top end refers_to
        from p""",
    "op7_maxscore_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) v
                   from embeddings where embedding is not null and len(embedding) > 0
                   and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id query_id, c.vec_id,
                     cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint) score
              from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
        select query_id, cast(rank as integer) rank, vec_id, score from r where rank <= 20""",
    "op9_hyperminhash_neardup": """
        with recursive d as (
            select doc_id, list_filter(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents where doc_id is not null),
        s as materialized (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3),
                                       lambda i: array_to_string(w[i:i + 4], ' ')))
                                  when len(w) > 0 then [array_to_string(w, ' ')] else [] end g from d),
        n as (select doc_id, cast(len(g) as bigint) n from s),
        every as materialized (select doc_id, unnest(g) g from s),
        e as materialized (select * from every where g in (select g from every group by g having count(*) > 1)),
        pairs as (select a.doc_id a, b.doc_id b, count(*) c from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by all),
        links as materialized (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
        sides as (select a, b from links union all select b, a from links),
        reach as (select doc_id node, doc_id other from n union select r.node, l.b from reach r join sides l on r.other = l.a),
        low as (select node, min(other) component_id from reach group by 1)
        select n.doc_id, n.n n_shingles, component_id, n.doc_id = component_id kept from n join low on node = n.doc_id""",
    "op11_cyclic_collocations": """
        with docs as (select row_number() over () d, coalesce(lang, 'und') lang,
                             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
        pieces as (select lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) p from docs),
        lists as (select lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') w from pieces),
        grams as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) phrase
                  from lists, (select unnest(range(1, 6)) k) where len(w) >= k),
        f as materialized (select lang, k, phrase, count(*) a from grams group by all),
        total as (select lang, sum(a) n from f where k = 1 group by lang),
        c as (select lang, k, phrase, a, string_split(phrase, ' ') w from f where k > 1 and a >= 100),
        cuts as (select c.lang, c.phrase, c.a, x.a l, y.a r, h n, z cut,
                        (1000::hugeint * c.a * h) // (x.a::hugeint * y.a) score
                 from (select c.*, total.n h, unnest(range(1, k)) z from c join total using (lang)) c
                 join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[:c.z], ' ')
                 join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.z + 1:], ' ')),
        best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
        inner_ as (select c.lang, array_to_string(c.w[i:i + m - 1], ' ') phrase, max(c.a) top
                   from c, (select unnest(range(2, 5)) m), (select unnest(range(1, 5)) i)
                   where m < c.k and i + m - 1 <= c.k group by all),
        kept as (select b.* from best b left join inner_ s on s.lang = b.lang and s.phrase = b.phrase
                 where s.top is null or 100 * s.top < 100 * b.a),
        ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from kept)
        select lang, cast(rank as bigint) rank, phrase, a, l, r, cast(n as bigint) n, cast(score as bigint) score
        from ranked where rank <= 2000""",
    "op13_collision_counting_ann": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) v
                   from embeddings where embedding is not null
                   and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
                   and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s as (select q.vec_id query_id, c.vec_id,
                     sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda z: (z[2] - z[1]) * (z[2] - z[1])))) score
              from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
        r as (select *, row_number() over (partition by query_id order by score, vec_id) rank from s)
        select query_id, cast(rank as integer) rank, vec_id, score from r where rank <= 10""",
}

"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremor.llm import audit, decontam, divergence, langid, licence_texts, licenses, linededup, lmscore, minhash, mixing, quality, simhash, topk, urls
from tremor.llm.common import crc_mod, table


def op1_decontamination(spark, sf_dir):
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, crc_mod(F.col("doc_id"), 3) != 1)
    return langid.predict(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op3_lm_score(spark, sf_dir):
    return lmscore.score(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark, sf_dir):
    return linededup.dedup_lines(table(spark, sf_dir, "documents"))


def op5_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known(spark))


def op6_topk_search(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return topk.search(rows, rows.where("vec_id % 50 = 0"), 5)


def op7_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 4) != 2)
    return quality.classify(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op8_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.fit(urls.rule_labels(pages))).select("page_id", "host", "path", "rule", "verdict")


def op11_filter_audit(spark, sf_dir):
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_divergence(spark, sf_dir):
    return divergence.divergence(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_SIZE = r"len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))"

OP1 = rf"""
with d as (select doc_id, coalesce('d' || doc_id, 't' || md5(coalesce(text, '-'))) as k, {_ALNUM} as w from documents),
i as (select item_id, w, least(len(w), 13) as m from (select item_id, {_ALNUM} as w from benchmark where item_id is not null) where len(w) > 0),
iw as (select distinct item_id, m, array_to_string(w[p:p + m - 1], ' ') as win from (select *, unnest(generate_series(1, len(w) - m + 1)) as p from i)),
dw as (select k, m, p, array_to_string(w[p:p + m - 1], ' ') as win
       from (select k, w, m, unnest(generate_series(1, len(w) - m + 1)) as p from d, (select distinct m from i) where len(w) >= m)),
h as (select k, p, dw.m, item_id from dw join iw on dw.win = iw.win and dw.m = iw.m),
c as (select k, count(distinct q) as n_hit from (select k, unnest(generate_series(p, p + m - 1)) as q from h) group by k),
t as (select k, count(*) as n_items, string_agg(s, ',' order by s) as ids from (select distinct k, cast(item_id as varchar) as s from h) group by k)
select doc_id, cast(n as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= n as contaminated
from (select k, any_value(doc_id) as doc_id, max(len(w)) as n from d group by k) left join c using (k) left join t using (k)
"""

OP4 = r"""
with s as (select doc_id, text, cast('0x' || substr(md5(text), 1, 15) as bigint) as r, string_split(text, chr(10)) as ls from documents),
u as (select distinct doc_id, r, text, ls from s where text is not null and doc_id is not null),
l as (select doc_id, r, p, ls[p + 1] as line from (select doc_id, r, ls, unnest(generate_series(0, len(ls) - 1)) as p from u)),
k as (select doc_id, r, p, line, n, row_number() over w as i, sum(n) over w as upto
      from (select *, len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as n from l) where n > 0
      window w as (partition by doc_id, r order by p)),
e as (select x.doc_id, x.r, x.i as a, y.i as b from k x join k y on x.doc_id = y.doc_id and x.r = y.r and y.i >= x.i and y.upto - x.upto + x.n >= 50),
f as (select doc_id, r, a, min(b) as b from e group by doc_id, r, a union select doc_id, r, max(a), b from e group by doc_id, r, b),
t as (select f.doc_id, f.r, a, b, string_agg(line, chr(10) order by i) as run from f join k on f.doc_id = k.doc_id and f.r = k.r and k.i between a and b group by all),
n as (select *, row_number() over (partition by run order by doc_id, r, a) as nth from t),
g as (select distinct k.doc_id, k.r, k.p from n join k on n.doc_id = k.doc_id and n.r = k.r and k.i between a and b where nth > 1),
o as (select l.doc_id, l.r, count(g.p) as n_deleted, string_agg(line, chr(10) order by l.p) filter (where g.p is null) as text
      from l left join g on l.doc_id = g.doc_id and l.r = g.r and l.p = g.p group by l.doc_id, l.r)
select s.doc_id, case when s.text is null then 0 else len(ls) end as n_lines, coalesce(n_deleted, 0) as n_deleted,
       case when s.doc_id is null then s.text when s.text is not null then coalesce(o.text, '') end as text
from s left join o on s.doc_id = o.doc_id and s.r = o.r
"""

_KNOWN = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in licence_texts.TEXTS)


def _canonical(text: str) -> str:
    c = f"regexp_replace(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{licenses.COPYRIGHT}', ' ', 'g')"
    c = rf"trim(regexp_replace({c}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'))"
    for old, new in licenses.SPELLINGS:
        c = rf"regexp_replace({c}, '\b{old}\b', '{new}', 'g')"
    return c


OP5 = f"""
with known as (select {_canonical("text")} as k, min(license_id) as license_id from (values {_KNOWN}) v(license_id, text) group by 1 having k <> ''),
d as (select doc_id, text, row_number() over () as r from (select doc_id, coalesce(text, '') as text from documents where doc_id is not null)),
l as (select r, i, {_canonical("line")} as c from (select r, ls[i] as line, i from (select r, ls, unnest(generate_series(1, len(ls))) as i from (select r, string_split(text, chr(10)) as ls from d)))),
p as (select r, i, c, sum(len(string_split(c, ' '))) over (partition by r order by i) as upto, len(string_split(c, ' ')) as n from l where c <> ''),
t as (select r, string_split(string_agg(c, ' ' order by i), ' ') as w from p group by r),
s as (select r, upto - n as before, license_id, len(string_split(k, ' ')) as m, k from p, known where split_part(c, ' ', 1) = split_part(k, ' ', 1)),
f as (select s.r, license_id, before = 0 and m = len(w) as whole from s join t using (r) where array_to_string(w[before + 1:before + m], ' ') = k and exists (select 1 from p where p.r = s.r and p.upto = before + m))
select doc_id, min(license_id) filter (where whole) as license, count(license_id) as n_notices, coalesce(string_agg(distinct license_id, ',' order by license_id), '') as notices from d left join f using (r) group by doc_id
"""

OP6 = """
with v as (select vec_id, min(x) as x from (
        select vec_id, list_transform(embedding, lambda e: cast(floor(256 * cast(e as double)) as double)) as x from embeddings
        where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0) group by vec_id),
s as (select q.vec_id as query_id, c.vec_id, cast(coalesce(list_dot_product(q.x, c.x), 0) as bigint) as score from v q, v c where q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as k from s)
select query_id, cast(k as integer) as rank, vec_id, score from r where k <= 5
"""

OP9 = rf"""
with d as (select doc_id, source, cast({_SIZE} as bigint) as size, md5(coalesce(cast(doc_id as varchar), '')) as k from documents),
s as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w
      from (select source, cast(sum(size) as bigint) as source_size from d group by source)),
f as (select *, sum(source_size) over () as total, sum(w) over () as all_w,
             coalesce(sum(source_size) over b, 0) as full_before, coalesce(sum(w) over b, 0) as w_before
      from s window b as (order by 3 * source_size / w, source nulls last rows between unbounded preceding and 1 preceding)),
g as (select *, (total - 3 * full_before)::double / (all_w - w_before) * w >= 3 * source_size as is_full from f),
e as (select ((select sum(source_size) from s) - 3 * coalesce(sum(source_size) filter (where is_full), 0))::double
             / nullif((select sum(w) from s) - coalesce(sum(w) filter (where is_full), 0), 0) as share from g),
t as (select source, source_size, case when is_full then 3.0::double * source_size else share * w end as target from g, e),
u as (select d.*, source_size, target, cast(sum(size) over (partition by d.source order by k, size rows unbounded preceding) as bigint) as upto
      from d join t on d.source is not distinct from t.source),
c as (select size, (r * source_size + upto)::double / target as finish from u, generate_series(0, 2) x(r) where size > 0),
l as (select max(finish) as cut from (select finish, sum(size) over (order by finish) as n from c) where n <= (select round(sum(target)) from t)),
o as (select *, (select cut from l) as cut from u)
select doc_id, size, source_size, target,
       case when size = 0 then 0 else size * (cast(upto / target <= cut as bigint) + cast((source_size + upto) / target <= cut as bigint) + cast((2 * source_size + upto) / target <= cut as bigint)) end as taken
from o
"""

OP11 = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
g as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id),
e as (select part, len(w) < 50 as a, 100 * len(list_distinct(w)) < 65 * len(w) as b, 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * len(text) as c,
             regexp_matches(text, '[#$%&*|]') as d, coalesce(d.doc_id > min(d.doc_id) over (partition by text), false) as e, coalesce(good, false) as good, coalesce(toxic, false) as toxic
      from d left join g on d.doc_id = g.doc_id),
f as (select part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x, i: [a, b, c, d, e][i]) as fails, count(*) as n from e group by all),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as l),
o as (select a.l || b.l || c.l || d.l || e.l as filter_order from l a, l b, l c, l d, l e where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
s as (select filter_order, cast(i as integer) as step, filter_order[i] as own, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: contains(filter_order[1:i - 1], x)) as before from o, generate_series(1, 5) t(i)),
r as (select part, filter_order, step, own, cast(coalesce(sum(n) filter (where not list_contains(fails, own) and not list_has_any(fails, before)), 0) as bigint) as kept,
             cast(coalesce(sum(n) filter (where list_contains(fails, own) and not list_has_any(fails, before)), 0) as bigint) as removed,
             cast(coalesce(sum(n) filter (where list_contains(fails, own) and list_has_any(fails, before)), 0) as bigint) as redundant,
             cast(coalesce(sum(n) filter (where fails = [own]), 0) as bigint) as unique_fails,
             cast(coalesce(sum(n) filter (where good and list_contains(fails, own) and not list_has_any(fails, before)), 0) as bigint) as good_lost,
             cast(coalesce(sum(n) filter (where toxic and list_contains(fails, own) and not list_has_any(fails, before)), 0) as bigint) as toxic_lost
      from f, s group by all)
select * exclude (own), cast(sum(removed) over (partition by part, own) as bigint) as shapley from r
"""

OP12 = rf"""
with recursive d as (select doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
h as (select doc_id, case when len(w) >= 4 then list_distinct([array_to_string(w[i:i + 3], ' ') for i in generate_series(1, len(w) - 3)]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from d),
n as (select s, len(s) as size, min(doc_id) as node from (select doc_id, list_sort(s) as s from h) group by s),
x as (select node, size, hash(unnest(s)) as g from n where size > 0),
p as (select a.node as a, b.node as b, count(*) as common, any_value(a.size + b.size) as total from x a join x b on a.g = b.g and a.node < b.node where 100 * least(a.size, b.size) >= 80 * greatest(a.size, b.size) group by a.node, b.node),
e as (select a, b from p where 100 * common >= 80 * (total - common)),
u as (select a, b from e union all select b, a from e),
r as (select node as a, node as b from n where size > 0 union select r.a, u.b from r join u on r.b = u.a),
c as (select a as node, min(b) as component_id from r group by a)
select doc_id, cast(len(h.s) as bigint) as n_shingles, coalesce(component_id, doc_id) as component_id, doc_id = coalesce(component_id, doc_id) as kept
from h left join n on list_sort(h.s) = n.s and n.size > 0 left join c using (node)
"""

OP13 = rf"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, list_filter(string_split_regex({_LOWER}, '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
t as (select r, lang, source, unnest(w) as term from d),
k as (select lang, term from t group by lang, term having count(distinct r) >= 10),
v as (select lang, cast(count(*) as hugeint) as v from k group by lang),
c as (select lang, source, term, cast(count(*) as hugeint) as n from t join k using (lang, term) group by all),
g as (select distinct lang, source from d),
s as (select lang, source, cast(coalesce(sum(n), 0) as hugeint) as total from g left join c using (lang, source) group by all),
p as (select lang, source, term, coalesce(n, 0) as n, 1 + 1000000000::hugeint * (coalesce(n, 0) + 2) // (total + 2 * v) as p from s join v using (lang) join k using (lang) left join c using (lang, source, term)),
q as (select lang, term, 1 + 1000000000::hugeint * (sum(n) + 2)::hugeint // ((sum(sum(n)) over (partition by lang))::hugeint + 2 * any_value(v)) as q from p join v using (lang) group by lang, term),
x as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
u as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(value, 0) as bigint) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join x on x.lang = a.lang and x.source = a.source and x.item = b.source
      union all select lang, source, 'term', term, cast((p - q) * (p - q) // (p + q) as bigint) from p join q using (lang, term) where n > 0 and p > q),
o as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from u)
select * from o where part = 'pair' or rank <= 10
"""

QUERIES = {f.__name__: f for f in (op1_decontamination, op2_language, op3_lm_score, op4_line_dedup, op5_license_scan, op6_topk_search, op7_quality, op8_simhash, op9_mixing, op10_url_filter, op11_filter_audit, op12_minhash, op13_divergence, pipeline)}
ORACLE_SQL = {"op1_decontamination": OP1, "op4_line_dedup": OP4, "op5_license_scan": OP5, "op6_topk_search": OP6, "op9_mixing": OP9, "op11_filter_audit": OP11, "op12_minhash": OP12, "op13_divergence": OP13}

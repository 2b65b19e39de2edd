"""The corpus operators bound to the driver's tables, each with SQL of the same result where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from bindings.inputs import Registry
from marketloom.llm import chosen_path, collocations, fingerprints, language, merge_replay, mixing, multiprobe, multiset_hash, secrets, suffixes, toxicity, url_rules, vector_codes

q = Registry()

MIX_SQL = """
with base as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
    md5('mix|' || coalesce(cast(doc_id as varchar), '')) as key from documents),
sources as (select source, cast(sum(size) as bigint) as source_size from base group by source),
ranked as (select *, row_number() over (order by source is null, encode(source)) as sid from sources),
weighed as (select *, (sid - 1) % 3 + 1 as weight, 3 * source_size as lim from ranked),
filled as (select *, cast(sum(source_size) over () as hugeint) - coalesce(sum(lim) over (order by lim / weight, sid rows between unbounded preceding and 1 preceding), 0) as rest,
    cast(sum(weight) over (order by lim / weight, sid rows between current row and unbounded following) as hugeint) as shares from weighed),
level as (select rest, shares from filled where rest * weight <= lim * shares order by lim / weight, sid limit 1),
plan as (select f.source, f.source_size, case when f.rest * f.weight <= f.lim * f.shares
    then cast((select rest from level) * f.weight as double) / cast((select shares from level) as double) else cast(f.lim as double) end as target from filled f),
laid as (select b.*, p.source_size, p.target, cast(floor(p.target) as bigint) as budget,
    coalesce(sum(b.size) over (partition by b.source order by b.key, b.doc_id, b.size rows between unbounded preceding and 1 preceding), 0) as start
    from base b join plan p on b.source is not distinct from p.source)
select doc_id, size, source_size, target, cast(case when source_size = 0 then 0 else (budget // source_size) * size
    + greatest(0, least(size, budget % source_size - start)) end as bigint) as taken from laid"""


# The rules for this table.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@q("op1_url_rules")
def op1(tables):
    told = url_rules.judge(tables.pages.select("page_id", "url"), URL_RULES)
    return told.select("page_id", "host", "path", "rule", "verdict", "mined_rule", "confidence")


@q("op2_toxicity")
def op2(tables):
    docs = tables.documents.select("doc_id", "text")
    fold = "crc32(cast(cast(doc_id as string) as binary)) % 5"
    model = toxicity.fit(docs, tables.labels.filter(f"{fold} != 0"))
    told = toxicity.score(docs, model)
    return told.select("doc_id", F.expr(f"coalesce({fold} = 0, false)").alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic_pred").alias("predicted"))


def language_model(docs):
    """Model of the labelled documents outside the held-out third."""
    return language.fit(docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 3 != 1"))


@q("op3_language")
def op3(tables):
    docs = tables.documents
    told = language.identify(docs.select("doc_id", "text"), language_model(docs))
    held_out = F.expr("coalesce(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, false)")
    return told.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "cross_entropy", F.col("lang_rejected").alias("rejected"))


@q("op4_jaccard_join")
def op4(tables):
    return chosen_path.similarity_join(tables.documents)


@q("op5_multiprobe")
def op5(tables):
    return multiprobe.nearest_neighbours(tables.embeddings, "id % 100 = 0")


@q("op6_suffix_dedup")
def op6(tables):
    told = suffixes.remove_repeats(tables.documents)
    kept, spans = F.col("kept"), F.col("spans")
    return told.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length(kept)).alias("n_removed"), F.size(spans).cast("long").alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256"))


SECRETS_SQL = """
with texts as (select doc_id, coalesce(text, '') as text from documents),
found as (select doc_id, 0 as number, 'assign' as kind, string_split_regex(text, '{assign}') as gaps,
    regexp_extract_all(text, '{assign}', 0) as own, regexp_extract_all(text, '{assign}', 2) as told, 6 as least from texts
  union all select doc_id, 1, 'access', string_split_regex(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), 20 from texts
  union all select doc_id, 2, 'hex', string_split_regex(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+'), 24 from texts),
each as (select *, unnest(range(1, len(own) + 1)) as i from found),
placed as (select doc_id, number, kind, length(own[i]) as n, length(told[i]) as size, least,
    sum(length(gaps[i])) over along + sum(length(own[i])) over along - length(own[i]) as start from each window along as (partition by doc_id, number order by i)),
kept as (select doc_id, number, kind, cast(start as bigint) as start, cast(start + n as bigint) as stop from placed where size >= least),
listed as (select doc_id, count(*) filter (where number = 0) as n_assign, count(*) filter (where number = 1) as n_access, count(*) filter (where number = 2) as n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, number) as spans from kept group by doc_id)
select t.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans from texts t left join listed l on t.doc_id = l.doc_id""".replace(
    "{assign}", r"(?i)(password|passwd|secret|token|api_?key)[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
)


@q("op7_secrets", SECRETS_SQL)
def op7(tables):
    found = F.col("findings")
    count = lambda kind: F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = secrets.listed(F.filter(found, lambda x: x["kind"].isin("assign", "access", "hex")))
    told = secrets.scan_history(tables.documents)
    return told.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), secrets.listed(found).alias("spans"))


def vocabulary() -> merge_replay.Vocabulary:
    return merge_replay.read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@q("op8_byte_bpe")
def op8(tables):
    told = merge_replay.digests(tables.documents.select("doc_id", "text"), vocabulary(), public_tokenizers.PATTERN)
    return told.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@q("op9_mix_sources", MIX_SQL)
def op9(tables):
    return mixing.mix(tables.documents).select("doc_id", "size", "source_size", "target", "taken")


@q("op10_exact_dedup", """select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = max(doc_id) over same as kept,
    sha256(coalesce(text, '')) as text_sha256 from documents window same as (partition by coalesce(text, ''))""")
def op10(tables):
    return fingerprints.exact_groups(tables.documents).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _multiset_sql() -> str:
    """The lanes of ``multiset_hash`` as sums over DuckDB's list of paragraphs."""
    pieces = lambda text: f"list_transform(regexp_extract_all({text}, '[^.!?\\x0A-\\x0D]+[.!?]*|[.!?]+'), lambda p: trim(p, ' '))"
    numbers = [f"cast('0x' || substr(sha256({salt}p), {1 + 15 * i}, 15) as bigint) as h{4 * j + i}" for j, salt in enumerate(("", "'+' || ")) for i in range(4)]
    low = (1 << 30) - 1
    wide = [f"cast(sum({part}) % {1 << 30} as bigint)" for i in range(8) for part in (f"h{i} & {low}", f"h{i} >> 30")]
    counts = [f"cast(sum((h{i} >> {s}) & {1 << 30 | 1}) as bigint)" for i in range(2) for s in range(30)]
    centred = lambda v: f"list_transform(list_concat(list_transform({v}[18:], lambda x: x & {low}), list_transform({v}[18:], lambda x: x >> 30)), lambda c: cast(2 * c - {v}[1] as double))"
    told = lambda v: f"list_aggregate(list_transform({v}, lambda x, i: lpad(lower(to_hex(x)), case when i > 1 and i <= 17 then 8 else 15 end, '0')), 'string_agg', '')"
    dot = lambda a, b: f"list_dot_product({a}, {b})"
    near = lambda a, b: f"case when {a} = {b} then 1.0 when {dot(a + 'c', a + 'c')} * {dot(b + 'c', b + 'c')} > 0 then greatest(0.0, least(1.0, {dot(a + 'c', b + 'c')} / sqrt({dot(a + 'c', a + 'c')} * {dot(b + 'c', b + 'c')}))) else 0.0 end"
    return f"""
with base as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n from documents),
chained as (select *, coalesce(lead(text) over along, first_value(text) over along) as beyond, coalesce(lead(doc_id) over along, first_value(doc_id) over along) as next_id
  from base window along as (order by doc_id desc)),
edited as (select *, substr(text, 1, n - n // 2) || substr(beyond, 1, n // 2) as changed from chained),
pieces as (select doc_id, 0 as kind, unnest({pieces("text")}) as p from edited union all select doc_id, 1, unnest({pieces("changed")}) from edited),
hashed as (select doc_id, kind, {", ".join(numbers)} from pieces),
sums as (select doc_id, kind, [cast(count(*) as bigint), {", ".join(wide + counts)}] as v from hashed group by doc_id, kind),
whole as (select e.doc_id, e.n, e.next_id, sha256(e.changed) as edited_sha256, coalesce(s.v, [cast(0 as bigint) for x in range(77)]) as a, coalesce(t.v, [cast(0 as bigint) for x in range(77)]) as b
  from edited e left join sums s on s.doc_id = e.doc_id and s.kind = 0 left join sums t on t.doc_id = e.doc_id and t.kind = 1),
met as (select w.*, o.a as o from whole w join whole o on o.doc_id = w.next_id),
ready as (select *, {centred("a")} as ac, {centred("b")} as bc, {centred("o")} as oc from met)
select doc_id, cast(n as bigint) as n_chars, edited_sha256, {told("a")} as fingerprint, {told("b")} as edited_fingerprint, {near("a", "b")} as near_edited, {near("a", "o")} as near_next from ready"""


@q("op11_multiset_hash", _multiset_sql())
def op11(tables):
    told = multiset_hash.edits(tables.documents)
    text = lambda c: multiset_hash.text_of(F.col(c))
    return told.select("doc_id", "n_chars", "edited_sha256", text("vector").alias("fingerprint"), text("edited_vector").alias("edited_fingerprint"), "near_edited", "near_next")


COLLOCATIONS_SQL = """
with pieces as (select coalesce(lang, 'und') as lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
numbered as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as ws, row_number() over () as p from pieces),
words as (select lang, p, unnest(ws) as w1, generate_subscripts(ws, 1) as i from numbered),
grams as (select lang, w1, lead(w1) over along as w2, lead(w1, 2) over along as w3 from words window along as (partition by p order by i)),
counts as (select lang, 1 as words, w1 as phrase, count(*) as a, w1, null as w2, null as w3 from grams group by all
  union all select lang, 2, w1 || ' ' || w2, count(*), w1, w2, null from grams where w2 is not null group by all
  union all select lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*), w1, w2, w3 from grams where w3 is not null group by all),
often as (select * from counts where a >= 10),
cuts as (select lang, phrase, a, 1 as k, w1 as head, case when words = 2 then w2 else w2 || ' ' || w3 end as rest from often where words > 1
  union all select lang, phrase, a, 2, w1 || ' ' || w2, w3 from often where words = 3),
scored as (select c.*, f.a as l, g.a as r, cast((cast(1000000 as hugeint) * c.a * c.a) // (cast(f.a as hugeint) * g.a) as bigint) as score
  from cuts c join often f on f.lang = c.lang and f.phrase = c.head join often g on g.lang = c.lang and g.phrase = c.rest),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
longer as (select lang, w1 || ' ' || w2 as phrase, a from often where words = 3 union all select lang, w2 || ' ' || w3, a from often where words = 3),
most as (select lang, phrase, max(a) as a from longer group by all),
free as (select l.* from lowest l left join most m on m.lang = l.lang and m.phrase = l.phrase where m.a is null or 100 * m.a < 50 * l.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from free),
total as (select lang, count(*) as n from words group by lang)
select r.lang, rank, phrase, a, l, r, n, score from ranked r join total t on t.lang = r.lang where rank <= 2000"""


@q("op12_collocations", COLLOCATIONS_SQL)
def op12(tables):
    return collocations.collocations(tables.documents)


def _codes_sql(rounds: int = 4) -> str:
    """Every round as one step: all entries against all parts."""
    apart = "cast(list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint)"
    near = f"select p.vec_id, p.part, min({{'d': {apart}, 'e': b.entry}}) as m from parts p join BOOK b on b.part = p.part group by p.vec_id, p.part"
    steps = []
    for i in range(rounds):
        steps.append(f"near{i} as materialized ({near.replace('BOOK', f'book{i}')})")
        steps.append(f"""sums{i} as (select part, e, list(cast(floor_div as bigint) order by j) as v from (
            select part, e, j, (s - ((s % c) + c) % c) // c as floor_div from (select n.part, n.m.e as e, u.j, cast(sum(u.x) as bigint) as s, count(*) as c
            from near{i} n join (select vec_id, part, unnest(v) as x, generate_subscripts(v, 1) as j from parts) u on u.vec_id = n.vec_id and u.part = n.part group by 1, 2, 3)) group by part, e)""")
        steps.append(f"book{i + 1} as materialized (select b.part, b.entry, coalesce(s.v, b.v) as v from book{i} b left join sums{i} s on s.part = b.part and s.e = b.entry)")
    last = near.replace("BOOK", f"book{rounds}")
    return f"""
with kept as (select vec_id, label, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 1024) as bigint)) as v from documents_free),
parts as materialized (select vec_id, t.part, v[t.part * len(v) // 4 + 1 : (t.part + 1) * len(v) // 4] as v from kept, (select unnest([0, 1, 2, 3]) as part) t),
book0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 as entry, v from parts qualify entry < 256),
{", ".join(steps)},
final as materialized ({last}),
told as (select vec_id, string_agg(lpad(lower(to_hex(m.e)), 2, '0'), '' order by part) as code, cast(sum(m.d) as bigint) as error from final group by vec_id),
digest as (select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) as codebooks_sha256 from book{rounds})
select t.vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
  from told t join kept k on k.vec_id = t.vec_id cross join digest""".replace("documents_free", "embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0")


@q("op13_vector_codes", _codes_sql())
def op13(tables):
    return vector_codes.encode(tables.embeddings).select("vec_id", "code", "error", "label_error", "codebooks_sha256")

"""DuckDB SQL of the subpackage's queries, where SQL can express them.

Written from the contracts alone. The sharding query finds the smallest capacity by
greedy passes over all candidates of two nested ranges, and has to spell out CRC-32; the
rules' accuracies come from a recursion over the counts of vote patterns.
"""

from __future__ import annotations

from revlens.llm.quality_rules import STOP_WORDS

OP9_SHARDING = """
with recursive
crc_table as (
  select list(v order by i) as t from (
    select i, list_reduce([i] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
    from (select unnest(range(256)) as i) as n) as x),
texts as (
  select text, strlen(text) + 1 as size, count(*) as copies, hex(encode(text)) as digits
  from (select coalesce(text, '') as text from documents) as d group by text),
checked as (
  select text, size, copies, sha256(text) as place, xor(4294967295, list_reduce(
      [cast(4294967295 as bigint)] || list_transform(range(size - 1), lambda i:
        cast(concat('0x', substr(digits, cast(2 * i + 1 as int), 2)) as bigint)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) as text_crc32
  from texts, crc_table),
ends as (
  select text, size, text_crc32, cast(sum(size * copies) over (order by place) as bigint) as finish, size * copies as bytes
  from checked),
bounds as (
  select cast(greatest(max(bytes), ceil(sum(bytes) / 16)) as bigint) as low, cast(max(bytes) as bigint) as width,
    cast(sum(bytes) as bigint) as total from ends),
coarse as (
  select cast(low + (width * i) // 200 as bigint) as capacity, total, 0 as step, cast(0 as bigint) as cut
  from bounds, (select unnest(range(201)) as i) as n
  union all
  select p.capacity, p.total, p.step + 1, coalesce(max(e.finish), p.cut)
  from coarse p asof left join ends e on p.cut + p.capacity >= e.finish
  where p.step < 16 group by p.capacity, p.total, p.step, p.cut),
window_ as (
  select coalesce((select max(capacity) from coarse where step = 16 and cut < total) + 1, min(low)) as first,
    (select min(capacity) from coarse where step = 16 and cut = total) as last from bounds),
fine as (
  select unnest(range(first, last + 1)) as capacity, total, 0 as step, cast(0 as bigint) as cut from window_, bounds
  union all
  select p.capacity, p.total, p.step + 1, coalesce(max(e.finish), p.cut)
  from fine p asof left join ends e on p.cut + p.capacity >= e.finish
  where p.step < 16 group by p.capacity, p.total, p.step, p.cut),
best as (select min(capacity) as capacity from fine where step = 16 and cut = total),
cuts as (select step, cut from fine join best using (capacity) where step between 1 and 15),
placed as (
  select d.doc_id, e.size, e.text_crc32, sha256(e.text) as place,
    cast((select count(*) from cuts where cut <= e.finish - e.bytes) as integer) as shard
  from documents d join ends e on coalesce(d.text, '') = e.text)
select doc_id, size, text_crc32, 'bytes' as law, shard,
  row_number() over (partition by shard order by place, doc_id) - 1 as slot, cast(null as integer) as grown_shard
from placed
"""

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS.split()))
_BLANK = r"\x20\x09-\x0D"
_VOTES = {
    "v0": ("n_words >= 80", "n_words < 20"),
    "v1": ("n_words > 0 and word_chars between 3 * n_words and 10 * n_words",
           "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    "v2": ("50 * n_symbols <= n_words", "8 * n_symbols > n_words"),
    "v3": ("n_lines > 1 and 10 * n_dup_lines <= n_lines", "3 * n_dup_lines > n_lines"),
    "v4": ("10 * n_repeat_words <= n_words", "4 * n_repeat_words > n_words"),
    "v5": ("n_stop >= 3", "n_words >= 20 and n_stop = 0"),
    "v6": ("n_lines > 0 and 2 * n_ended >= n_lines", "n_lines > 0 and n_ended = 0"),
    "v7": ("word_chars > 0 and 10 * n_upper <= word_chars", "3 * n_upper > word_chars"),
}
_POSTERIOR = "1 / (1 + exp(-(ln(share / (1 - share))" + "".join(
    f" + case {v} when 1 then ln(g[{j}] / (1 - b[{j}])) when -1 then ln((1 - g[{j}]) / b[{j}]) else 0 end"
    for j, v in enumerate(_VOTES, 1)) + ")))"


def _accuracies(weight: str, right: int, start: float) -> str:
    return "[" + ", ".join(
        f"least(0.998, greatest(0.002, (coalesce(sum({weight}) filter ({v} = {right}), 0) + {start}) / "
        f"(coalesce(sum({weight}) filter ({v} <> 0), 0) + 1)))" for v in _VOTES) + "]"


# Every turn of the recursion is one round of expectation-maximisation over the vote patterns.
OP2_QUALITY_RULES = rf"""
with recursive
texts as (select row_number() over () as id, doc_id, coalesce(text, '') as text from documents),
parts as (
  select id, doc_id, text, regexp_extract_all(text, '[^{_BLANK}]+') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_BLANK}]')) as lines from texts),
words as (select id, unnest(words) as w, unnest(range(len(words))) as spot from parts),
triples as (
  select id, spot, w, lead(w) over s as w2, lead(w, 2) over s as w3 from words window s as (partition by id order by spot)),
often as (select id, spot, count(*) over (partition by id, w, w2, w3) as n from triples where w3 is not null),
repeats as (
  select id, count(distinct place) as n_repeat_words
  from (select id, unnest([spot, spot + 1, spot + 2]) as place from often where n > 1) as r group by id),
counts as (
  select id, doc_id, len(words) as n_words,
    cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
    len(lines) as n_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '[.!?:;"''’”»)\]…]\s*$'))) as n_ended,
    len(regexp_extract_all(text, '\p{{Lu}}')) as n_upper, len(list_intersect(list_distinct(words), [{_STOP}])) as n_stop
  from parts left join repeats using (id)),
voted as (
  select *, {", ".join(f"case when {bad} then -1 when {good} then 1 else 0 end as {v}" for v, (good, bad) in _VOTES.items())}
  from counts),
patterns as (select {", ".join(_VOTES)}, cast(count(*) as double) as n from voted group by all),
em as (
  select 0 as turn, cast(0.8 as double) as share, cast({[0.9] * 8} as double[]) as g, cast({[0.3] * 8} as double[]) as b,
    cast(1 as double) as moved
  union all
  select turn + 1, new_share, new_g, new_b, greatest(abs(new_share - share),
    {", ".join(f"abs(new_g[{j}] - g[{j}]), abs(new_b[{j}] - b[{j}])" for j in range(1, 9))})
  from (
    select turn, share, g, b, (sum(good) + 1) / (sum(n) + 2) as new_share,
      {_accuracies("good", 1, 0.9)} as new_g, {_accuracies("bad", -1, 0.3)} as new_b
    from (select *, n * post as good, n - n * post as bad
          from (select *, {_POSTERIOR} as post from em, patterns where turn < 60 and moved >= 1e-6) as q) as r
    group by turn, share, g, b) as t),
fitted as (select share, g, b from em order by turn desc limit 1)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and {_POSTERIOR} >= 0.5 as kept
from voted, fitted
"""

# A string of 200 bytes is told by its MD5; runs of starts at most 200 apart leave no byte between them.
OP5_SUFFIX_REPEATS = """
with texts as (
  select doc_id, row_number() over () as row, encode(coalesce(text, '')) as bytes from documents),
starts as (
  select row, i, md5(array_slice(bytes, i + 1, i + 200)) as print
  from (select row, bytes, unnest(range(octet_length(bytes) - 199)) as i from texts where octet_length(bytes) >= 200) as t),
again as (select row, i from starts where print in (select print from starts group by print having count(*) > 1)),
lined as (
  select row, i, sum(fresh) over (partition by row order by i) as run
  from (select row, i, case when i <= lag(i) over (partition by row order by i) + 200 then 0 else 1 end as fresh
        from again) as t),
runs as (select row, run, min(i) as a, max(i) + 200 as b from lined group by row, run),
kept as (
  select row, string_agg(hex(array_slice(bytes, a + 1, b)), '' order by a) as h
  from (select row, bytes, coalesce(lag(r.b) over (partition by row order by r.a), 0) as a, r.a as b
        from texts join runs as r using (row)
        union all
        select row, bytes, max(r.b), octet_length(bytes) from texts join runs as r using (row) group by row, bytes) as t
  where a < b
  group by row),
cut as (select row, sum(b - a)::bigint as n_removed, count(*) as n_spans from runs group by row)
select doc_id, octet_length(bytes) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(case when cut.row is null then bytes else unhex(coalesce(k.h, '')) end) as kept_sha256
from texts as t left join cut using (row) left join kept as k using (row)
"""

# Classes are what is reached over links; every pair of texts with a common shingle is formed.
OP7_NEAR_DUPLICATES = """
with recursive texts as (
  select text, min(doc_id) as least, row_number() over () as node,
    regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w
  from documents where text is not null group by text),
shingles as (
  select node, g, count(*) as n
  from (select node, array_to_string(w[i:i + 4], ' ') as g
        from (select node, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from texts where len(w) > 0) as t) as u
  group by node, g),
sizes as (select node, sum(n) as n from shingles group by node),
links as (
  select a, b from (
    select x.node as a, y.node as b, sum(least(x.n, y.n)) as shared
    from shingles as x join shingles as y on x.g = y.g and x.node <> y.node
    group by a, b) as p
  join sizes as s on s.node = a join sizes as t on t.node = b
  where 10 * shared >= 8 * (s.n + t.n - shared)),
reached(node, other) as (
  select node, node from texts
  union
  select r.node, l.b from reached as r join links as l on l.a = r.other),
classes as (select r.node, min(t.least) as class_id from reached as r join texts as t on t.node = r.other group by r.node)
select d.doc_id, case when d.text is null then d.doc_id else c.class_id end as class_id
from documents as d left join texts as t on t.text = d.text left join classes as c on c.node = t.node
"""

OP11_EXACT_DEDUP = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
  doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents
window same as (partition by coalesce(text, ''))
"""

# Counts of all phrases of up to five words; words hold no blank, so phrases are joined by one.
OP12_PHRASES = """
with pieces as (
  select coalesce(lang, 'und') as lang, row_number() over () as piece,
    list_filter(string_split_regex(part, '[ \\t]+'), lambda x: x <> '') as w
  from (select lang, unnest(string_split_regex(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as part
        from documents where text is not null) as t),
starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from pieces),
grams as (
  select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, m, count(*) as n
  from starts, (select unnest(range(1, 6)) as m) as sizes
  where i + m - 1 <= len(w)
  group by all),
totals as (select lang, sum(n)::bigint as n from grams where m = 1 group by lang),
often as (select lang, phrase, m, n as a, string_split(phrase, ' ') as w from grams where n >= 100),
cuts as (
  select lang, phrase, m, a, k, array_to_string(w[1:k], ' ') as first, array_to_string(w[k + 1:], ' ') as rest
  from (select *, unnest(range(1, m)) as k from often where m > 1) as t),
scored as (
  select c.lang, c.phrase, c.m, c.a, c.k, x.a as l, y.a as r, t.n,
    (1000::hugeint * c.a * t.n // (x.a::hugeint * y.a))::bigint as score
  from cuts as c
  join often as x on x.lang = c.lang and x.phrase = c.first
  join often as y on y.lang = c.lang and y.phrase = c.rest
  join totals as t on t.lang = c.lang),
lowest as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (
  select distinct lang, array_to_string(w[i:i + p - 1], ' ') as phrase, p, a as longer
  from (select *, unnest(range(1, m - p + 2)) as i
        from (select *, unnest(range(2, m)) as p from often where m > 2) as t) as u)
select lang, (row_number() over (partition by lang order by score desc, a desc, phrase))::integer as rank,
  phrase, a, l, r, n, score
from lowest as c
where not exists (select 1 from inside as i where i.lang = c.lang and i.phrase = c.phrase and 100 * i.longer >= 100 * c.a)
qualify rank <= 2000
"""


def _op13_clusters(clusters: int = 40, rounds: int = 5) -> str:
    """Every round is a pair of tables: each vector's nearest centroid, and the centroids it gives."""
    near = """
near{t} as (
  select vec_id, row, min(struct_pack(distance := d, cluster := c)) as best
  from (select k.vec_id, k.row, c.cluster as c, list_sum(list_transform(range(1, 65),
          lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))::bigint as d
        from kept as k, centroids{t} as c) as t
  group by vec_id, row)"""
    mean = """
centroids{u} as (
  select cluster, coalesce(m.v, c.v) as v from centroids{t} as c left join (
    select cluster, list(floor_sum order by i) as v
    from (select n.best.cluster as cluster, i,
            ((sum(k.v[i]) - ((sum(k.v[i]) % count(*) + count(*)) % count(*))) // count(*))::bigint as floor_sum
          from kept as k join near{t} as n on n.row = k.row, (select unnest(range(1, 65)) as i) as places
          group by all) as s
    group by cluster) as m using (cluster))"""
    steps = [near.format(t=0)]
    for t in range(rounds):
        steps += [mean.format(t=t, u=t + 1), near.format(t=t + 1)]
    return f"""
with kept as materialized (
  select vec_id, row_number() over () as row, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: isfinite(x))) = 64),
centroids0 as (
  select (row_number() over (order by sha256('2:' || vec_id), v) - 1)::integer as cluster, v
  from kept qualify cluster < {clusters}),{",".join(s.replace(" as (", " as materialized (", 1) for s in steps)}
select vec_id, best.cluster as cluster, best.distance as distance,
  (sum(best.distance) over (partition by best.cluster))::bigint as cluster_inertia,
  (sum(best.distance) over ())::bigint as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from near{rounds} as n join centroids{rounds} as c on c.cluster = n.best.cluster
"""


ORACLE: dict[str, str] = {
    "op2_quality_rules": OP2_QUALITY_RULES,
    "op5_suffix_repeats": OP5_SUFFIX_REPEATS,
    "op7_near_duplicates": OP7_NEAR_DUPLICATES,
    "op9_sharding": OP9_SHARDING,
    "op11_exact_dedup": OP11_EXACT_DEDUP,
    "op12_phrases": OP12_PHRASES,
    "op13_clusters": _op13_clusters(),
}

"""DuckDB SQL with the results of the registered queries, built from shared parts."""

from __future__ import annotations

from ..functions import text as T

CJK = r"[\x{4e00}-\x{9fff}]"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _tokens(table: str, key: str, text: str) -> str:
    """(query_id, pos, token) in order of first place, without short ASCII tokens."""
    return f"""select query_id, min(i) as pos, token from (
  select {key} as query_id, unnest(regexp_extract_all(lower({text}), '[0-9A-Za-z_]+|{CJK}{{2,}}')) as token, generate_subscripts(regexp_extract_all(lower({text}), '[0-9A-Za-z_]+|{CJK}{{2,}}'), 1) as i from {table})
where not (regexp_full_match(token, '[0-9A-Za-z_]+') and length(token) < 3) group by query_id, token"""


INDEX = f"""
texts as (select doc_id as block_uid, source as note_path, lower(text) as low from documents),
tok as (select block_uid, note_path, regexp_extract_all(low, '[0-9a-z_]+|{CJK}+') as tokens from texts),
posts as (select term, block_uid, count(*) as tf from (select block_uid, unnest(tokens) as term from tok) group by all),
terms as (select term, count(*) as df from posts group by 1),
dls as (select block_uid, note_path, len(tokens) as dl from tok),
totals as (select count(*) as n, avg(dl) as avgdl from dls)"""


MIXED = INDEX.replace("lower(text) as low", "lower(text || case doc_id % 3 when 0 then ' 分布式事务处理 数据库' when 1 then ' 分布式 snake_case' else '' end) as low")


def _informative(qtok: str = "qtok", name: str = "inf") -> str:
    return f"""
{name}_known as (select q.query_id, pos, token, coalesce(df, 0) as df, n from {qtok} q left join terms on term = token cross join totals where token not in {_in(T.LEXICAL_STOP)}),
{name}_flag as (select *, not (df >= 12 and df >= 0.25 * n) as good from {name}_known),
{name} as (select query_id, pos, token, df, ln((n + 1)::double / (df + 1)) + 1 as weight from (
  select *, max(good::int) over (partition by query_id) as has_any, row_number() over (partition by query_id order by df, pos) as rn from {name}_flag) where good or (has_any = 0 and rn = 1))"""


def _bm25(tokens: str, k: int, name: str) -> str:
    return f"""
{name} as (select * from (select *, row_number() over (partition by query_id order by bm25 desc, block_uid) as rn from (
  select query_id, p.block_uid, note_path, round(sum(greatest(1e-6::double, ln((n - df + 0.5::double) / (df + 0.5::double))) * tf * 2.2::double / (tf + 1.2::double * (1 - 0.75::double + 0.75::double * dl / avgdl))), 10) as bm25
  from {tokens} t join posts p on p.term = t.token join dls d on d.block_uid = p.block_uid cross join totals group by query_id, p.block_uid, note_path)) where rn <= {k})"""


def _lexical(k: int, inf: str = "inf", name: str = "lex") -> str:
    return f"""
{name}_first as (select * from (select *, row_number() over (partition by query_id order by pos) as nth from {inf}) where nth <= 16),{_bm25(f"{name}_first", 4 * k, f"{name}_fetched")},
{name}_norm as (select *, case when max(bm25) over w = min(bm25) over w then 1.0::double else (bm25 - min(bm25) over w) / (max(bm25) over w - min(bm25) over w) end as norm from {name}_fetched window w as (partition by query_id)),
{name}_words as (select distinct block_uid, token from (select block_uid, unnest(tokens) as token from tok)),
{name}_cover as (select query_id, block_uid, sum(weight) as covered from (
  select query_id, f.block_uid, weight from {name}_fetched f join {inf} i using (query_id) join {name}_words w on w.token = i.token and w.block_uid = f.block_uid where i.token ~ '[0-9a-z_]+'
  union all select query_id, f.block_uid, weight from {name}_fetched f join {inf} i using (query_id) join texts t on t.block_uid = f.block_uid and contains(low, i.token) where i.token !~ '[0-9a-z_]+') group by all),
{name}_total as (select query_id, sum(weight) as total from {inf} group by 1),
{name}_found as (select query_id, block_uid, note_path, lex_score, lex_rank from (select *, row_number() over (partition by query_id order by lex_score desc, block_uid) as lex_rank from (
  select n.query_id, n.block_uid, n.note_path, round(0.7::double * norm + 0.3::double * coalesce(covered, 0) / total, 6) as lex_score
  from {name}_norm n left join {name}_cover c on c.query_id = n.query_id and c.block_uid = n.block_uid join {name}_total t on t.query_id = n.query_id)) where lex_rank <= {k}),{_like(k, inf, f"{name}_like")},
{name} as (select * from {name}_found union all select * from {name}_like)"""


def _like(k: int, inf: str = "inf", name: str = "liked") -> str:
    return f"""
{name}_eight as (select * from (select *, max(df) filter (nth <= 16) over (partition by query_id) as met from (select *, row_number() over (partition by query_id order by pos) as nth from {inf})) where nth <= 8 and met = 0),
{name}_hits as (select query_id, block_uid, note_path, sum(weight) as matched from texts join {name}_eight on contains(low, token) and (not regexp_full_match(token, '[0-9A-Za-z_]+') or regexp_matches(low, '(^|[^0-9A-Za-z_])' || token || '($|[^0-9A-Za-z_])')) group by all),
{name}_five as (select h.*, round(matched / total, 6) as lex_score from (select *, row_number() over (partition by query_id order by block_uid) as seen from {name}_hits) h join (select query_id, sum(weight) as total from {name}_eight group by 1) using (query_id) where seen <= 500),
{name} as (select query_id, block_uid, note_path, lex_score, lex_rank from (select *, row_number() over (partition by query_id order by lex_score desc, block_uid) as lex_rank from {name}_five where lex_score > 0) where lex_rank <= {k})"""


DOC_Q = """
q as (select doc_id as query_id, source as src_note, text, embedding from documents left join embeddings on vec_id = doc_id where doc_id % 50 = 0)"""


def _semantic(k: int, exclude: str = "", name: str = "sem") -> str:
    return f"""
{name} as (select * from (select *, row_number() over (partition by query_id order by semantic_score desc, block_uid) as sem_rank from (
  select q.query_id, e.vec_id as block_uid, d.source as note_path, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) as semantic_score
  from q join embeddings e on q.embedding is not null join documents d on d.doc_id = e.vec_id {exclude})) where sem_rank <= {k})"""


EDGES = """
edges as (select distinct source as src, 'src' || ((regexp_extract(source, '(\\d+)', 1)::int + 1) % 20) as dst from documents)"""


def _fused(boost: bool, name: str = "fused") -> str:
    graph = "case when exists (select 1 from edges e join q on q.src_note = e.src where q.query_id = b.query_id and e.dst = b.note_path) then 1.0::double else 0.0::double end" if boost else "0.0::double"
    return f"""
{name}_both as (select coalesce(s.query_id, l.query_id) as query_id, coalesce(s.block_uid, l.block_uid) as block_uid, coalesce(s.note_path, l.note_path) as note_path,
  greatest(0::double, least(1::double, coalesce(semantic_score, 0))) as semantic, greatest(0::double, least(1::double, coalesce(lex_score, 0))) as lexical, cast(coalesce(sem_rank, lex_rank + 1000000) as bigint) as ord
  from sem s full outer join lex l on s.query_id = l.query_id and s.block_uid = l.block_uid),
{name}_scored as (select b.*, lexical * (0.2::double + 0.8::double * semantic) as lexical_effective, sqrt(semantic * lexical) as synergy, {graph} as graph_boost from {name}_both b),
{name} as (select *, round(0.72::double * semantic + 0.18::double * lexical_effective + 0.05::double * graph_boost + 0.05::double * synergy, 6) as final_score from {name}_scored)"""


def _relaxed(t: float, relax: bool, name: str = "relaxed", of: str = "fused") -> str:
    return f"""
{name} as (select * exclude (has_any) from (select *, max((final_score >= {t})::int) over (partition by query_id) as has_any from {of}) where final_score >= {t}{' or has_any = 0' if relax else ''})"""


def _varied(of: str, k: int = 10, name: str = "varied") -> str:
    return f"""
{name} as (select * exclude (nth, ord, place), place as ord from (select *, row_number() over (partition by query_id order by round(final_score - 0.08::double * (nth - 1), 6) desc, final_score desc, ord) as place from (
  select *, row_number() over (partition by query_id, note_path order by final_score desc, ord) as nth from {of}) where nth <= 2) where place <= {k})"""


def _anchors(table: str, key: str, text: str) -> str:
    return f"select query_id, token from ({_tokens(table, key, text)}) where token not in {_in(T.ANCHOR_STOP)}"


def _reranked(of: str = "varied", k: int = 10, name: str = "ranked") -> str:
    return f"""
{name}_q as ({_anchors('q', 'query_id', 'text')}),
{name}_b as ({_anchors(f'(select * from documents where doc_id in (select block_uid from {of}))', 'doc_id', 'text')}),
{name}_n as (select query_id, count(*) as n from {name}_q group by 1),
{name}_o as (select v.query_id, v.block_uid, count(*) as shared from {of} v join {name}_q a on a.query_id = v.query_id join {name}_b b on b.query_id = v.block_uid and b.token = a.token group by all),
{name}_x as (select v.*, coalesce(n, 0) as n, round(coalesce(shared, 0)::double / greatest(1, coalesce(n, 0)), 6) as content_anchor from {of} v left join {name}_n using (query_id) left join {name}_o o on o.query_id = v.query_id and o.block_uid = v.block_uid),
{name}_s as (select *, least(0.95::double, 0.65::double + case when lexical <= 0.05 and graph_boost <= 0 and content_anchor < 0.12 then 0.2::double else 0 end + case when lexical <= 0.1 and content_anchor < 0.08 then 0.1::double else 0 end
  + case when semantic < 0.35 and lexical <= 0.05 and graph_boost <= 0 then 0.1::double else 0 end) as strength from {name}_x),
{name}_m as (select * replace (case when n = 0 then final_score else round(final_score * (1 - strength * (1 - content_anchor)), 6) end as final_score) from {name}_s),
{name} as (select * exclude (ord, place), place as ord from (select *, row_number() over (partition by query_id order by final_score desc, ord) as place from {name}_m where final_score > 0 or n = 0) where place <= {k})"""


def _sql(*parts: str) -> str:
    return "with " + ",".join(parts[:-1]) + "\n" + parts[-1]


PHRASE_TOK = f"""
qw as (select item_id, regexp_extract_all(lower(text), '[0-9a-z]+') as w from benchmark),
q as (select item_id as query_id, concat_ws(' ', array_to_string(w[1:2], '_'), array_to_string(w[4:6], '_'), array_to_string(w[9:10], '_'), w[13]) as text from qw),
qtok as ({_tokens('q', 'query_id', 'text')}),
tok as (select doc_id as block_uid, source as note_path, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as tokens from documents),
places as (select block_uid, unnest(tokens) as word, generate_subscripts(tokens, 1) as p from tok),
split as (select distinct token, regexp_extract_all(token, '[\\p{{L}}\\p{{N}}]+') as parts from qtok),
parts as (select token, len(parts) as n, unnest(parts) as word, generate_subscripts(parts, 1) as i from split),
starts as (select token, block_uid, p - i as start from parts join places using (word) group by token, n, block_uid, p - i having count(*) = n),
posts as (select token as term, block_uid, count(*) as tf from starts group by all),
terms as (select term, count(*) as df from posts group by 1),
dls as (select block_uid, note_path, len(tokens) as dl from tok),
totals as (select count(*) as n, avg(dl) as avgdl from dls)"""
BENCH_TOK = f"qtok as ({_tokens('benchmark', 'item_id', 'text')})"
DOC_TOK = f"qtok as ({_tokens('q', 'query_id', 'text')})"
HYBRID = (INDEX, DOC_Q, DOC_TOK, _informative(), _lexical(20), _semantic(20), EDGES, _fused(True))
LABELLED = """
q as (select vec_id as query_id, embedding, label from embeddings where vec_id % 50 = 0)"""


COPIES = """
own as (select vec_id as block_uid, embedding::double[] as e from embeddings),
copied as (select * from own union all select block_uid + 1000000, list_concat([e[1] + 0.05::double * (block_uid % 8)], e[2:]) from own where block_uid % 5 = 0),
near as (select a.block_uid as a, b.block_uid as b, round(list_cosine_similarity(a.e, b.e), 6) as cosine from copied a join copied b on a.block_uid < b.block_uid),
pairs as (select * from near where cosine > 0.98),
hits as (select query_id, block_uid, ord from (select *, row_number() over (partition by query_id order by score desc, block_uid) as ord from (
  select q.block_uid as query_id, c.block_uid, round(list_cosine_similarity(q.e, c.e), 6) as score from own q, copied c where q.block_uid % 50 = 0)) where ord <= 10)"""
CLUSTERED = """
led as (select query_id, block_uid, ord, e from hits join copied using (block_uid)),
fold as (select query_id, block_uid, ord, 1 as cluster, [block_uid] as leaders, [e] as vs from led where ord = 1
  union all select l.query_id, l.block_uid, l.ord, coalesce(nullif(x, 0), len(f.leaders) + 1), case when x > 0 then f.leaders else list_append(f.leaders, l.block_uid) end, case when x > 0 then f.vs else list_append(f.vs, l.e) end
  from fold f join led l on l.query_id = f.query_id and l.ord = f.ord + 1, lateral (select coalesce(list_position([round(list_cosine_similarity(v, l.e), 6) >= 0.6 for v in f.vs], true), 0) as x))"""


def _neighbours(k: int, where: str = "", name: str = "sem") -> str:
    return f"""
{name} as (select * from (select *, row_number() over (partition by query_id order by semantic_score desc, block_uid) as sem_rank from (
  select q.query_id, e.vec_id as block_uid, e.label::varchar as note_path, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) as semantic_score from q, embeddings e {where})) where sem_rank <= {k})"""


THREE = """
lists as (select query_id, list_idx, sem_rank as item_idx, block_uid, note_path, round(semantic_score / (list_idx + 1), 6) as score
  from sem, (values (0, 2), (1, 3), (2, 1)) as p(list_idx, m) where sem_rank % m = 0)"""
TURNS = r"""
b as (select conv_id::varchar as note_path, turn as ord, conv_id || ':' || turn as block_uid, role, text as raw_text, trim(regexp_replace(text, '\s+', ' ', 'g')) as clean_text from conversations)"""
# A stack of clean-text steps that RE2 and Java share.
CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x},
 '<!--.*?-->', ' ', 'gs'), '\[\[([^|\]]+)\|([^\]]+)\]\]', '\2', 'g'), '\[\[([^\]|]*)[^\]]*\]\]', '\1', 'g'), '!\[[\s\x{{a0}}]*\]\([^)]+\)|\[[\s\x{{a0}}]+\]\([^)]+\)', ' ', 'g'),
 '!\[\s*([^\]]*?)\s*\]\([^)]+\)|\[\s*([^\]]+?)\s*\]\([^)]+\)', '\1\2', 'g'), 'https?://[^\s)>]+', ' ', 'g'), '[\s\x{{a0}}\x{{0b}}\x{{85}}\x{{2028}}\x{{2029}}]+', ' ', 'g'))"""


def _variants() -> str:
    base, kw, comp, quest = _in(T.EXPANSION_STOP), _in(T.KEYWORD_STOP), _in(T.COMPACT_STOP), _in(T.QUESTION_WORDS)
    pattern = f"[0-9A-Za-z_]+|{CJK}{{2,}}"
    kept = lambda stop: f"coalesce((select string_agg(t, ' ' order by i) from (select lower(t) as low, arg_min(t, i) as t, min(i) as i from (select unnest(tokens) as t, generate_subscripts(tokens, 1) as i) where lower(t) not in {base} and lower(t) not in {stop} and length(t) >= 2 group by lower(t))), '')"
    return f"""
plain as (select query_id, plain, regexp_extract_all(plain, '{pattern}') as tokens from (select query_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as plain from asked) where plain <> ''),
kept as (select query_id, plain, {kept(kw)} as kw, case when contains(plain, '?') or len(tokens) >= 7 or lower(coalesce(tokens[1], '')) in {quest} then {kept(comp)} else '' end as comp from plain),
every as (select query_id, 0 as i, plain as text, 'original' as source, 1.0::double as weight from kept union all select query_id, 1, kw, 'keyword', 0.85::double from kept union all select query_id, 2, comp, 'compact', 0.7::double from kept),
variants as (select query_id, row_number() over (partition by query_id order by i) - 1 as variant_idx, text, source, weight from (select *, row_number() over (partition by query_id, lower(text) order by i) as n from every where text <> '') where n = 1)"""


def _values(rows, names: str) -> str:
    quote = lambda v: "'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else "null" if v is None else str(v)
    return "select * from (values " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + f") as v({names})"


STATES = """
old as (select doc_id::varchar as path, sha1(text) as h from documents where doc_id % 5 <> 0),
new as (select doc_id::varchar as path, case when doc_id % 11 = 0 then sha1(sha1(text) || 'x') else sha1(text) end as h from documents where doc_id % 7 <> 0)"""
LOG = """
log as (select doc_id // 3 as id, doc_id as seq, case when doc_id % 3 = 2 then 'success' else 'running' end as status, source as detail from documents),
latest as (select id, arg_max(status, seq) as status, arg_max(detail, seq) as detail, count(*) as events from log group by id)"""
EVAL = (LABELLED, _neighbours(20), """
truth as (select q.query_id, e.vec_id as target from q join embeddings e on e.label = q.label and e.vec_id <> q.query_id),
sizes as (select query_id, count(*) as n_true from truth group by 1),
pred as (select s.query_id, s.block_uid as target, sem_rank as rank, (t.target is not null)::int as hit from sem s left join truth t on t.query_id = s.query_id and t.target = s.block_uid),
per as (select query_id, sum(hit) filter (rank <= 5) as h5, sum(hit) filter (rank <= 10) as h10, count(*) filter (rank <= 5) as r5, count(*) filter (rank <= 10) as r10, min(rank) filter (hit = 1) as first from pred group by 1),
j as (select s.query_id, n_true, coalesce(h5, 0) as h5, coalesce(h10, 0) as h10, coalesce(r5, 0) as r5, coalesce(r10, 0) as r10, first from sizes s left join per using (query_id))""")

TABLE = """
tab as (select s.query_id, n_true as n_targets, coalesce(string_agg(target::varchar, ',' order by rank), '') as predicted, coalesce(string_agg(target::varchar, ',' order by target) filter (hit = 1 and rank <= 5), '') as hits_5, coalesce(string_agg(target::varchar, ',' order by target) filter (hit = 1 and rank <= 10), '') as hits_10,
  count(*) filter (hit = 1 and rank <= 10) as n_hits, coalesce(string_agg(target::varchar, ',' order by target) filter (hit = 0 and rank <= 10), '') as false_positives_10, count(*) filter (hit = 0 and rank <= 10) as n_false from sizes s left join pred using (query_id) group by s.query_id, n_true)"""
LINKED = """
own as (select d.doc_id as i, d.text, 'cs/n' || d.doc_id || '.md' as path, case when d.doc_id % 10 = 0 then o.doc_id end as outside, (a.doc_id is not null)::int + (b.doc_id is not null)::int as n_internal,
  concat_ws(',', least(x, y), nullif(greatest(x, y), least(x, y))) as targets from (select *, doc_id + 5 as j, doc_id + 10 as k, doc_id + 4 as l from documents where doc_id % 5 <> 4) d
  left join documents a on a.doc_id = d.j left join documents b on b.doc_id = d.k left join documents o on o.doc_id = d.l, lateral (select 'cs/n' || a.doc_id || '.md' as x, 'cs/n' || b.doc_id || '.md' as y))"""

_LINKS = [
    ("cs/a%.md", "wiki", 0, "wikilink", "the b", "b%.md", "Part one", None), ("cs/a%.md", "wiki", 1, "embed", None, "img%.png.md", None, None), ("cs/a%.md", "wiki", 2, "wikilink", None, "32.4 x%.md", None, None),
    ("cs/a%.md", "md", 1, "mdlink", "y", "c%.md", None, "k1"),
    ("cs/b%.md", "wiki", 0, "wikilink", None, "other%.md", None, None), ("cs/b%.md", "wiki", 1, "wikilink", None, ".md", "here", None), ("cs/b%.md", "md", 0, "mdlink", "pic", "d%.md", None, None), ("cs/b%.md", "md", 1, "mdlink", "mail", "mailto:q@e.org.md", None, None),
    ("cs/sub/c%.md", "wiki", 0, "wikilink", None, "../a%.md", None, None), ("cs/sub/c%.md", "wiki", 1, "wikilink", None, "a%.md", None, None), ("cs/sub/c%.md", "wiki", 2, "wikilink", None, "zz%.md", None, None), ("cs/sub/c%.md", "wiki", 3, "wikilink", None, "dup%.md", None, None), ("cs/sub/c%.md", "md", 0, "mdlink", "t", "b%.md", None, None),
    ("cs/y/dup%.md", "wiki", 0, "wikilink", None, "cs/a%.md", None, None), ("cs/y/dup%.md", "wiki", 1, "embed", "B", "b%.md", None, "id9"),
    ("other%.md", "wiki", 0, "wikilink", None, "cs/b%.md", None, None), ("other%.md", "wiki", 1, "wikilink", "", "a%.md", None, None),
]
_RESOLVED = [
    ("cs/a%.md", "32.4 x%", "non_markdown_target", None), ("cs/a%.md", "b%#Part one", "resolved_internal", "cs/b%.md"), ("cs/a%.md", "c%.md#^k1", "resolved_internal", "cs/sub/c%.md"), ("cs/a%.md", "https://e.org/q", "external_scheme", None), ("cs/a%.md", "img%.png", "non_markdown_target", None),
    ("cs/b%.md", "#here", "same_note_anchor", None), ("cs/b%.md", "d%.md", "unresolved_note_target", None), ("cs/b%.md", "mailto:q@e.org", "external_scheme", None), ("cs/b%.md", "other%", "resolved_external", "other%.md"),
    ("cs/sub/c%.md", "../a%", "resolved_internal", "cs/a%.md"), ("cs/sub/c%.md", "a%", "resolved_internal", "cs/a%.md"), ("cs/sub/c%.md", "b%.md", "resolved_internal", "cs/b%.md"), ("cs/sub/c%.md", "dup%", "ambiguous_note_target", None), ("cs/sub/c%.md", "zz%", "unresolved_note_target", None),
    ("cs/y/dup%.md", "b%#^id9", "resolved_internal", "cs/b%.md"), ("cs/y/dup%.md", "cs/a%.md", "resolved_internal", "cs/a%.md"), ("other%.md", "a%", "resolved_internal", "cs/a%.md"), ("other%.md", "cs/b%", "resolved_internal", "cs/b%.md"),
]
#: Character places are those behind the note's first line.
_BLOCKS = [
    ("n%.md:auto-00002", "n%.md", 2, "A", "one", "one", 5, 9), ("n%.md:id1", "n%.md", 3, "A/B", "two\nmore ^id1", "two more ^id1", 15, 29),
    ("n%.md:auto-00004", "n%.md", 4, "A/B/C", "three", "three", 39, 45), ("n%.md:solo", "n%.md", 5, "A/D", "^solo", "^solo", 50, 56),
]
_OTHER_BLOCKS = [("m%.md:auto-00001", "m%.md", 1, "T", "x <!-- gone -->\r", "x", 7, 24), ("m%.md:auto-00002", "m%.md", 2, "T", "y\r", "y", 43, 46)]


def _each(rows, names: str, text: str, extra: str = "") -> str:
    """The rows for each document, with its id in place of % in the columns `text`."""
    columns = ", ".join(f"replace({c}, '%', doc_id::varchar) as {c}" if c in text.split() else c for c in names.split(", "))
    return f"select {extra}{columns} from documents, ({_values(rows, names)})"


SQL = {
    "scan_inventory": "select source as note_path, count(*) as blocks, cast(sum(length(text)) as bigint) as chars from documents group by source",
    "content_hash": "select doc_id, sha1(text) as content_hash, greatest(1, length(text) // 4) as token_count_est from documents",
    "path_exclude": _each([("a%.md", False), (".trash/x%.md", True), (".trash-x/y%.md", True), ("draft/z%.md", True), ("draft2/z%.md", False), ("n/private/q%.md", True), ("t/_tmp%.md", True)], "path, excluded", "path"),
    "link_extract": _each(_LINKS, "src_note_path, kind, no, link_type, link_text, dst_note_path, dst_heading, dst_block_id", "src_note_path dst_note_path"),
    "link_target_parse": _each([(0, "b%.md", None, None), (1, "b%.md", None, None), (2, ".md", None, None), (3, "https://e.org/%.md", None, None), (4, "mailto:a@b%.md", None, None), (5, ".md", "top%", None), (6, ".md", None, "k%"), (7, "pic%.PNG.md", None, None), (8, "32.4 x%.md", None, None), (9, "a%/b.md", "h", None), (10, "n%.md", None, "q"), (11, "x%.MD.md", None, None), (12, ".hidden%.md", None, None), (13, "/abs/note%.md", None, None), (14, "t%..md", None, None)], "k, path, heading, block", "path heading block", "doc_id, "),
    "target_classify": _each([(0, "markdown_note_target", "b%.md"), (1, "markdown_note_target", "b%.md"), (2, "empty_target", None), (3, "external_scheme", None), (4, "external_scheme", None), (5, "same_note_anchor", None), (6, "same_note_anchor", None), (7, "non_markdown_target", None), (8, "non_markdown_target", None), (9, "markdown_note_target", "a%/b.md"), (10, "markdown_note_target", "n%.md"), (11, "markdown_note_target", "x%.MD"), (12, "markdown_note_target", ".hidden%.md"), (13, "markdown_note_target", "abs/note%.md"), (14, "markdown_note_target", "t%..md")], "k, status, normalized", "normalized", "doc_id, "),
    "link_resolve": _each(_RESOLVED, "path, raw, status, resolved", "path raw resolved"),
    "eval_dataset": _each([("cs/a%.md", "cs/b%.md"), ("cs/a%.md", "cs/sub/c%.md"), ("cs/sub/c%.md", "cs/a%.md"), ("cs/sub/c%.md", "cs/b%.md"), ("cs/y/dup%.md", "cs/a%.md"), ("cs/y/dup%.md", "cs/b%.md")], "path, target", "path target"),
    "clean_text_fixture": _each([(0, "a b n%"), (1, "Bee and Cee n%"), (2, "alt lab n%"), (3, "see ) end n%"), (4, "tail n%"), (5, "many spaces here n%"), (6, "A x n%"), (7, "中文 乙 文 n%")], "k, clean_text", "clean_text", "doc_id, "),
    "heading_stack_blocks": _sql("firsts as (select doc_id, trim('intro ' || trim(regexp_replace(substring(text, 1, 60), '[^a-zA-Z]+', ' ', 'g'))) as line from documents)", "behind as (" + _each(_BLOCKS, "block_uid, note_path, ord, heading_path, raw_text, clean_text, char_start, char_end", "block_uid note_path", "doc_id, ") + ")", """select 'n' || doc_id || '.md:auto-00001' as block_uid, 'n' || doc_id || '.md' as note_path, 1 as ord, '' as heading_path, line as raw_text, line as clean_text, 0 as char_start, length(line) + 1 as char_end from firsts
  union all select b.* exclude (doc_id) replace (b.char_start + length(line) as char_start, b.char_end + length(line) as char_end) from behind b join firsts using (doc_id) union all """ + _each(_OTHER_BLOCKS, "block_uid, note_path, ord, heading_path, raw_text, clean_text, char_start, char_end", "block_uid note_path")),
    "clean_text_pages": f"select page_id, sha1({CLEAN.format(x='html')}) as clean_sha1, length({CLEAN.format(x='html')}) as n from pages",
    "tag_extract": r"select doc_id, coalesce((select string_agg(t, ',' order by t) from (select distinct unnest(regexp_extract_all(text, '(^|[^\p{L}\p{N}_])#([a-zA-Z0-9_\-/]+)', 2)) as t)), '') as tags from documents",
    "token_extract": f"with t as ({_tokens('documents', 'doc_id', 'text')}) select doc_id, sha1(coalesce(string_agg(token, ' ' order by pos), '')) as tokens_sha1, count(token) as n_tokens from documents left join t on query_id = doc_id group by doc_id",
    "highlight_tokens": f"with pair as (select item_id, b.text as a, d.text as o from benchmark b join documents d on d.doc_id = b.item_id), a as (select item_id, t, min(i) as i from (select item_id, unnest(regexp_extract_all(a, '[0-9A-Za-z_]+|{CJK}+')) as t, generate_subscripts(regexp_extract_all(a, '[0-9A-Za-z_]+|{CJK}+'), 1) as i from pair) group by item_id, t), o as (select distinct item_id, lower(unnest(regexp_extract_all(o, '[0-9A-Za-z_]+|{CJK}+'))) as low from pair), r as (select a.item_id, t, i, row_number() over (partition by a.item_id order by i) as n from a join o on o.item_id = a.item_id and o.low = lower(t)) select p.item_id, coalesce(string_agg(t, ' ' order by i), '') as tokens from pair p left join r on r.item_id = p.item_id and n <= 24 group by p.item_id",
    "block_merge_short": _sql(TURNS, """
g as (select *, sum(opens::int) over (partition by note_path order by ord) as grp from (select *, length(clean_text) >= 80 or row_number() over (partition by note_path order by ord) = 1 as opens from b)),
m as (select note_path, arg_min(block_uid, ord) as block_uid, string_agg(raw_text, chr(10) order by ord) as raw_text, min(ord) as char_start, max(ord) as char_end from g group by note_path, grp)""", f"select block_uid, note_path, sha1(raw_text) as raw_sha1, sha1({CLEAN.format(x='raw_text')}) as block_hash, char_start, char_end from m"),
    "block_split_fixed": "select case when n > 1 then doc_id || ':part' || (part + 1) else doc_id::varchar end as block_uid, case when n > 1 then doc_id || '-part' || (part + 1) else doc_id::varchar end as block_id, part, sha1(substring(text, (part * 1200 + 1)::bigint, 1200)) as block_hash from (select doc_id, text, greatest(1, ceil(length(text) / 1200)::bigint) as n, unnest(range(greatest(1, ceil(length(text) / 1200)::bigint))) as part from documents)",
    "block_split_overlap": _sql(
        r"plain as (select doc_id, trim(regexp_replace(text, '[\s\x{a0}\x{0b}\x{85}\x{2028}\x{2029}]+', ' ', 'g')) as t from documents)",
        "sentences as (select doc_id, t, i, unnest(range(greatest(1, ceil(length(s) / 1200)::bigint))) as k, s from (select doc_id, t, unnest(m) as s, generate_subscripts(m, 1) as i from (select doc_id, t, case when length(t) <= 1200 then [t] else regexp_extract_all(t, '[^.!?。！？]*[.!?。！？]+ *|[^.!?。！？]+') end as m from plain)))",
        "pieces as (select doc_id, list(p order by i, k) as ps from (select doc_id, i, k, case when length(t) <= 1200 then t else substring(s, k * 1200 + 1, 1200) end as p from sentences) group by doc_id)",
        "sums as (select doc_id, ps, list_concat([0], list(e order by n)) as upto from (select doc_id, ps, n, sum(length(ps[n])) over (partition by doc_id order by n) as e from (select doc_id, ps, unnest(range(1, len(ps) + 1)) as n from pieces)) group by doc_id, ps)",
        """parts as (select doc_id, ps, upto, 0 as part, 0::bigint as a, list_max([e for e in range(1, len(ps) + 1) if upto[e + 1] <= 1200]) as b from sums
  union all select doc_id, ps, upto, part + 1, f, list_max([e for e in range(f + 1, len(ps) + 1) if upto[e + 1] - upto[f + 1] <= 1200]) from (
    select *, list_min([j for j in range(a + 1, b + 1) if upto[b + 1] - upto[j + 1] <= 120 and upto[b + 2] - upto[j + 1] <= 1200]) as f from parts where b < len(ps)))""",
        "cut as (select doc_id, part, trim(array_to_string(ps[a + 1:b], '')) as t, count(*) over (partition by doc_id) as n from parts)",
        "select case when n > 1 then doc_id || ':part' || (part + 1) else doc_id::varchar end as block_uid, cast(part as bigint) as part, length(t) as n_chars, sha1(t) as block_hash from cut",
    ).replace("with ", "with recursive ", 1),
    "embed_input_heading": _sql(TURNS, "select block_uid, sha1(substring('Heading: ' || role || chr(10) || 'Current: ' || clean_text, 1, 2400)) as input_sha1 from b"),
    "embed_input_sliding": _sql(TURNS, "select block_uid, sha1(substring('Heading: ' || role || chr(10) || coalesce('Neighbor: ' || lag(clean_text) over w || chr(10), '') || 'Current: ' || clean_text || coalesce(chr(10) || 'Neighbor: ' || lead(clean_text) over w, ''), 1, 2400)) as input_sha1 from b window w as (partition by note_path order by ord)"),
    "pseudo_embedding": "with r as (select doc_id, i, ('0x' || substring(sha256(text), 2 * (i % 32) + 1, 2))::int / 255.0::double - 0.5::double as x from documents, range(64) t(i)), n as (select doc_id, sqrt(sum(x * x)) as norm from r group by 1) select doc_id, " + ", ".join(f"round(max(x / norm) filter (i = {i}), 6) as v{i}" for i in range(4)) + ", round(sum((x / norm) * (x / norm)), 6) as norm from r join n using (doc_id) group by doc_id",
    "token_df": _sql(BENCH_TOK, INDEX, "select query_id, token, coalesce(df, 0) as df, n from qtok left join terms on term = token cross join totals"),
    "informative_tokens": _sql(BENCH_TOK, INDEX, _informative(), "select query_id, token, df, round(weight, 6) as weight from inf"),
    "near_vector_pairs": _sql(COPIES, "select a, b, cosine from pairs"),
    "near_hit_removal": _sql(COPIES, "select query_id, block_uid, ord from hits h where not exists (select 1 from hits g join pairs p on (p.a = g.block_uid and p.b = h.block_uid) or (p.b = g.block_uid and p.a = h.block_uid) where g.query_id = h.query_id and g.ord < h.ord)"),
    "hit_clusters": _sql(COPIES, CLUSTERED, "select query_id, block_uid, ord, cast(cluster as bigint) as cluster, leaders[cluster] as leader from fold").replace("with ", "with recursive ", 1),
    "phrase_topk": _sql(PHRASE_TOK, _informative(), _bm25("inf", 20, "top"), "select query_id, block_uid, bm25, rn from top"),
    "bm25_topk": _sql(BENCH_TOK, INDEX, _informative(), _bm25("inf", 20, "top"), "select query_id, block_uid, bm25, rn from top"),
    "lexical_search": _sql(BENCH_TOK, INDEX, _informative(), _lexical(10), "select * from lex"),
    "like_fallback": _sql("asked as (" + _values([(1, "事务处理 zzzq"), (2, "式事务 数据 snake"), (3, "the"), (4, "qqq 布式")], "query_id, text") + ")", f"qtok as ({_tokens('asked', 'query_id', 'text')})", MIXED, _informative(), _like(10), "select * from liked"),
    "lexical_search_cjk": _sql("asked as (select item_id as query_id, text || case when item_id % 2 = 0 then ' 分布式事务 snake' else ' 分布式 snake_case' end as text from benchmark union all " + _values([(1000000 + i, t) for i, t in enumerate(["事务处理", "snake 式事务 zzzq", "数据", "布式"])], "query_id, text") + ")", f"qtok as ({_tokens('asked', 'query_id', 'text')})", MIXED, _informative(), _lexical(10), "select * from lex"),
    "cosine_topk": _sql(LABELLED, _neighbours(10), "select * from sem"),
    "cosine_topk_exclude": _sql(LABELLED, _neighbours(10, "where e.label <> q.label"), "select * from sem"),
    "query_expand": _sql("asked as (select item_id as query_id, text from benchmark union all " + _values([(1000000 + i, t) for i, t in enumerate(["How do I safely cut a cake?", "cake", " Cake  CAKE cake ", "如何 解释 分布式", "what is it", "one two three four five six seven", ""])], "query_id, text") + ")", _variants(), "select query_id, variant_idx, text, source, weight from variants"),
    "merge_candidates": _sql(LABELLED, _neighbours(12), THREE, "select query_id, block_uid, hits, row_number() over (partition by query_id order by hits desc, li, ii) as ord from (select query_id, block_uid, count(*) as hits, min(list_idx) as li, arg_min(item_idx, list_idx) as ii from lists group by all)"),
    "merge_scored_hits": _sql(LABELLED, _neighbours(12), THREE, "select query_id, block_uid, note_path, score, row_number() over (partition by query_id order by hits desc, li, ii) as ord from (select query_id, block_uid, note_path, max(score) as score, count(*) as hits, min(list_idx) as li, arg_min(item_idx, list_idx) as ii from lists group by all)"),
    "graph_boost": _sql(DOC_Q, _semantic(10), EDGES, "select s.query_id, block_uid, case when e.src is null then 0.0::double else 1.0::double end as graph_boost from sem s join q using (query_id) left join edges e on e.src = q.src_note and e.dst = s.note_path"),
    "fuse_scores": _sql(*HYBRID, "select query_id, block_uid, note_path, semantic, lexical, graph_boost, round(lexical_effective, 6) as lexical_effective, round(synergy, 6) as synergy, final_score, ord from fused"),
    "threshold_relax": _sql(*HYBRID, _relaxed(0.95, True), "select query_id, block_uid, final_score, ord from relaxed"),
    "note_diversity": _sql(*HYBRID, _varied("fused"), "select query_id, block_uid, note_path, final_score, ord from varied"),
    "anchor_rerank": _sql(*HYBRID, _varied("fused"), _reranked(), "select query_id, block_uid, content_anchor, final_score, ord from ranked"),
    "dedup_hits": _sql(*HYBRID, "select note_path, block_uid, final_score, ord from (select note_path, block_uid, final_score, query_id * 10000000 + ord as ord, row_number() over (partition by note_path, block_uid order by query_id * 10000000 + ord) as n from fused) where n = 1"),
    "group_by_note": _sql(*HYBRID, """
g as (select *, row_number() over (partition by query_id, note_path order by ord) as block_rank, max(final_score) over (partition by query_id, note_path) as note_score, min(ord) over (partition by query_id, note_path) as first from fused),
r as (select *, dense_rank() over (partition by query_id order by note_score desc, first, note_path) as note_rank from g)""", "select query_id, note_path, note_score, note_rank, block_uid, final_score, block_rank from r where block_rank <= 3"),
    "enrich_hits": _sql(*HYBRID, _varied("fused"), "select query_id, block_uid, substring(text, 1, 220) as snippet, length(text) as n_chars from varied join documents on doc_id = block_uid"),
    "search_e2e": _sql(INDEX, DOC_Q, "asked as (select query_id, text from q)", _variants(), "vq as (select query_id * 8 + variant_idx as query_id, text from variants)", f"qtok as ({_tokens('vq', 'query_id', 'text')})", _informative(), _lexical(80, name="each"), """
lists as (select query_id // 8 as query_id, query_id % 8 as list_idx, lex_rank as item_idx, block_uid, note_path, lex_score from each),
lex as (select query_id, block_uid, note_path, lex_score, row_number() over (partition by query_id order by hits desc, li, ii) as lex_rank from (select query_id, block_uid, note_path, max(lex_score) as lex_score, count(*) as hits, min(list_idx) as li, arg_min(item_idx, list_idx) as ii from lists group by all))""", _semantic(80), _fused(False), _relaxed(0.55, True), _varied("relaxed"), _reranked(), "select query_id, block_uid, note_path, content_anchor, final_score, ord, substring(text, 1, 220) as snippet from ranked join documents on doc_id = block_uid"),
    "query_block_e2e": _sql(INDEX, DOC_Q, DOC_TOK, _informative(), _lexical(40), _semantic(40), EDGES, _fused(True), _relaxed(0.05, False), _varied("relaxed"), _reranked(), "select query_id, block_uid, note_path, graph_boost, content_anchor, final_score, ord, substring(text, 1, 220) as snippet from ranked join documents on doc_id = block_uid"),
    "query_note_e2e": _sql(INDEX, DOC_Q, DOC_TOK, _informative(), _lexical(80), _semantic(80, "and d.source <> q.src_note"), EDGES, _fused(True), _relaxed(0.05, False), _varied("relaxed"), _reranked(), """
flat as (select src_note as of_note, note_path, block_uid, final_score, b.block_ord * 1000000 + ord as ord from ranked join (select query_id, src_note, row_number() over (partition by src_note order by query_id) as block_ord from q) b using (query_id)),
once as (select * exclude (n) from (select *, row_number() over (partition by of_note, note_path, block_uid order by ord) as n from flat) where n = 1),
g as (select *, row_number() over (partition by of_note, note_path order by ord) as block_rank, max(final_score) over (partition by of_note, note_path) as note_score, min(ord) over (partition by of_note, note_path) as first from once),
r as (select *, dense_rank() over (partition by of_note order by note_score desc, first, note_path) as note_rank from g)""", "select of_note, note_path, note_score, note_rank, block_uid, final_score, block_rank from r where block_rank <= 3"),
    "file_diff": _sql(STATES, "select path, change from (select coalesce(o.path, n.path) as path, case when o.h is null then 'added' when n.h is null then 'deleted' when o.h <> n.h then 'modified' end as change from old o full outer join new n on o.path = n.path) where change is not null"),
    "delete_note_cascade": _sql(EDGES, "select source as note_path, count(*) as n, 'block' as kind from documents where source not in ('src3', 'src7') group by 1 union all select src, count(*), 'link' from edges where src not in ('src3', 'src7') and dst not in ('src3', 'src7') group by 1"),
    "blocks_by_note": "select source as note_path, doc_id as block_uid, row_number() over (partition by source order by length(text), doc_id) as place from documents",
    "job_latest": _sql(LOG, "select * from latest"),
    "index_status": _sql(LOG, EDGES, "select (select count(distinct source) from documents) as notes, (select count(*) from documents) as blocks, (select count(*) from edges) as links, (select max(id) from latest) as last_job, (select arg_max(status, id) from latest) as last_status"),
    "eval_metrics": _sql(*EVAL, "select round(avg((h5 > 0)::int), 6) as hit_at_5, round(avg((h10 > 0)::int), 6) as hit_at_10, round(avg(h5::double / n_true), 6) as recall_at_5, round(avg(h10::double / n_true), 6) as recall_at_10, round(avg(h5::double / greatest(1, r5)), 6) as precision_at_5, round(avg(h10::double / greatest(1, r10)), 6) as precision_at_10, round(avg(coalesce(1.0::double / first, 0)), 6) as mrr, round(avg((h10 > 0)::int), 6) as coverage, round(avg(n_true::double), 6) as avg_truth from j"),
    "eval_worst": _sql(*EVAL, "select t.query_id, count(*) as missed from truth t left join (select * from sem where sem_rank <= 10) s on s.query_id = t.query_id and s.block_uid = t.target where s.block_uid is null group by 1 order by missed desc, t.query_id limit 10"),
    "eval_predictions": _sql(*EVAL, TABLE, "select query_id, n_targets, predicted, hits_5, hits_10, n_targets - n_hits as n_misses, false_positives_10 from tab"),
    "eval_false_positives": _sql(*EVAL, TABLE, "select query_id, false_positives_10 from tab order by n_false desc, query_id limit 10"),
    "eval_misses": _sql(*EVAL, TABLE, "select query_id, hits_10, n_targets - n_hits as n_misses from tab order by n_hits, n_targets - n_hits desc, query_id limit 10"),
    "eval_grid": _sql(*EVAL, """
runs as (select * from (values ('three', 3), ('seven', 7), ('all', 20)) as r(run, depth)),
p2 as (select run, s.query_id, s.block_uid as target, sem_rank as rank, (t.target is not null)::int as hit from runs join sem s on sem_rank <= depth left join truth t on t.query_id = s.query_id and t.target = s.block_uid),
per2 as (select run, query_id, sum(hit) filter (rank <= 5) as h5, sum(hit) filter (rank <= 10) as h10, count(*) filter (rank <= 5) as r5, count(*) filter (rank <= 10) as r10, min(rank) filter (hit = 1) as first from p2 group by all),
j2 as (select runs.run, s.query_id, n_true, coalesce(h5, 0) as h5, coalesce(h10, 0) as h10, coalesce(r5, 0) as r5, coalesce(r10, 0) as r10, first from runs cross join sizes s left join per2 on per2.run = runs.run and per2.query_id = s.query_id)""",
        "select j2.run, count(*) as dataset_note_count, (select count(distinct target) from p2 where p2.run = j2.run) as candidate_note_count, round(avg(n_true::double), 6) as avg_gt_links_per_note, round(avg((h5 > 0)::int), 6) as hit_at_5, round(avg(h10::double / n_true), 6) as recall_at_10, round(avg(h5::double / greatest(1, r5)), 6) as precision_at_5, round(avg(h10::double / greatest(1, r10)), 6) as precision_at_10, round(avg(coalesce(1.0::double / first, 0)), 6) as mrr from j2 group by j2.run"),
    "eval_notes": _sql(LINKED, "select path, targets, n_internal, 4 - n_internal as n_ignored, sha1(text || ' n' || (i + 5) || ' and see G [site](https://e.org/' || i || ')' || case when i % 10 = 0 then ' n' || (i + 4) else '' end) as body_sha1 from own where outside is null").replace("4 - n_internal", "4 - n_internal + (i % 10 = 0)::int"),
    "eval_dropped_notes": _sql(LINKED, "select path, 'n' || (i + 4) || '>out/n' || (i + 4) || '.md' as external from own where outside is not null"),
}

# the search over the allowed documents only; the queries are those of all
SQL["search_tags_any"] = SQL["search_e2e"].replace("from documents", "from allowed").replace("join documents", "join allowed").replace(DOC_Q.replace("from documents", "from allowed"), DOC_Q).replace("with ", "with allowed as (select * from documents where regexp_extract(source, '(\\d+)', 1)::int % 3 = 1), ", 1)

"""SQL twins of the core's queries, for DuckDB over the same tables."""

from __future__ import annotations

from .functions.scalars import STOPWORDS
from .operators import evaluation, fulltext

NOW = "timestamptz '2025-07-01 00:00:00+00'"
_DOCS = "docs as (select collection, path, title, text as body, hash from documents where active = 1 and text is not null)"
_SPLIT = r"list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


_RANKING, _SUMMARY = fulltext.Phrase(("ranking",)), fulltext.Phrase(("summary",))


def _bm25(phrases: list[fulltext.Phrase], title_weight: float = 1.0, split: str = _SPLIT, stems: dict[str, str] | None = None) -> str:
    """CTEs that end in ``found(collection, path, hash, score)``.  The phrases are written out here: the parser has no part in them."""

    def count(column: str, p: fulltext.Phrase) -> str:
        def equal(x: str, j: int) -> str:
            word = p.tokens[j]
            if stems:
                return f"regexp_full_match({x}, '{stems[word]}')"
            return f"starts_with({x}, '{word}')" if p.prefix and j == len(p.tokens) - 1 else f"{x} = '{word}'"

        n = len(p.tokens)
        if n == 1:
            return f"len(list_filter({column}, lambda t: {equal('t', 0)}))"
        return f"len(list_filter(range(1, greatest(len({column}) - {n - 2}, 1)), lambda i: {' and '.join(equal(f'{column}[i + {j}]', j) for j in range(n))}))"

    wanted = [i for i, p in enumerate(phrases) if not p.negated]
    ns = ", ".join(f"{' + '.join(count(c, p) for c in 'ptb')} as n{i}" for i, p in enumerate(phrases))
    fs = ", ".join(f"10.0 * {count('p', phrases[i])} + {title_weight} * {count('t', phrases[i])} + {count('b', phrases[i])} as f{i}" for i in wanted)
    dfs = ", ".join(f"count(*) filter (n{i} > 0) as df{i}" for i in wanted)
    keep = " and ".join(f"n{i} = 0" if p.negated else f"n{i} > 0" for i, p in enumerate(phrases))
    idf = "(case when ln((docs - df{0} + 0.5) / (df{0} + 0.5)) > 0 then ln((docs - df{0} + 0.5) / (df{0} + 0.5)) else 1e-6 end)"
    raw = " + ".join(f"{idf.format(i)} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * size / average))" for i in wanted)
    return f"""with {_DOCS},
tokens as (select collection, path, hash, {split.format('path')} as p, {split.format('title')} as t, {split.format('body')} as b from docs),
counted as (select collection, path, hash, len(p) + len(t) + len(b) as size, {ns}, {fs} from tokens),
stats as (select collection, count(*) as docs, avg(size) as average, {dfs} from counted group by collection),
raws as (select collection, path, hash, {raw} as raw from counted join stats using (collection) where {keep}),
found as (select collection, path, hash, raw / (1 + raw) as score from raws)"""


def _search(phrases: list[fulltext.Phrase], limit: int = 20, title_weight: float = 1.0, min_score: float | None = None, **stemming) -> str:
    least = "" if min_score is None else f"and score >= {min_score}"
    return _bm25(phrases, title_weight, **stemming) + f"""
select collection, path, round(raw_score, 6) as score, '#' || substr(hash, 1, 6) as doc_id from (
  select *, score as raw_score, row_number() over (partition by collection order by round(score, 9) desc, path) as r from found) where r <= {2 * limit} {least}
order by round(raw_score, 9) desc, collection, path limit {limit}"""


_SCORES = """scores as (
  select distinct s.request_id as query_id, s.list_no as list_id, l.kind, l.score_type, l.better, l.weight, s.collection, s.path, s.score
  from search_result s join (select distinct request_id, list_no, kind, score_type, better, weight from ranked_list) l
    on s.request_id = l.request_id and s.list_no = l.list_no
  where s.score is not null and not isnan(s.score))"""


def _top(source: str, limit: int, by: str = "query_id", extra: str = "") -> str:
    return f"select * from (select *, row_number() over (partition by {by} order by round(score, 9) desc, collection, path) as rank from {source}) where rank <= {limit} {extra}"


def _side(name: str, score_type: str) -> str:
    return f"{name} as (select query_id, collection, path, max(score) as score from scores where score_type = '{score_type}' group by all)"


def _fused(name: str, limit: int, alpha: float | str = 0.8) -> str:
    return f"""{name}_all as (select query_id, collection, path, {alpha} * coalesce(v.score, 0) + (1 - {alpha}) * coalesce(b.score, 0) as score
  from b full join v using (query_id, collection, path)),
{name} as ({_top(name + '_all', limit)})"""


_TWO = f"{_SCORES}, {_side('b', 'bm25_norm')}, {_side('v', 'cosine')}"
_OUT = "query_id, collection, path, round(score, 6) as score, rank"
_LISTS = """lists as (select *, row_number() over (partition by query_id, list_id order by good desc, collection, path) - 1 as rank0 from (
  select query_id, list_id, kind, weight, collection, path, max(case when better = 'lower' then -score else score end) as good from scores group by all))"""
_RRF = "sum(weight / (60 + rank0 + 1) + case when rank0 = 0 then 0.05 when rank0 <= 2 then 0.02 else 0 end) as score"
_PAIR = "select query_id, max(score) filter (rank = 1) as a, max(score) filter (rank = 2) as b2 from {0} group by query_id"
_QRELS = f"""{_side('y', 'yesno')},
qrels as (select query_id, collection || '/' || path as doc, case when score >= 0.8 then 2 when score >= 0.5 then 1 end as relevance from y where score >= 0.5),
ideal as (select query_id, sum(case when i <= 10 then (pow(2.0, relevance) - 1) / log2(i + 1) end) as idcg, count(*) as relevant
  from (select *, row_number() over (partition by query_id order by relevance desc) as i from qrels) group by query_id)"""


def _metrics(name: str, source: str) -> str:
    return f"""{name} as (select query_id, coalesce(dcg / idcg, 0) as ndcg, coalesce(hits / relevant, 0) as recall from ideal left join (
  select query_id, sum((pow(2.0, relevance) - 1) / log2(rank + 1)) as dcg, count(*) as hits from (select query_id, collection || '/' || path as doc, rank from {source}) join qrels using (query_id, doc) group by query_id) using (query_id))"""


def _grid(parameter: str, source: str) -> str:
    """Mean metrics per value of a grid column of a ranked source."""
    return f"""select {parameter}, round(avg(coalesce(dcg / idcg, 0)), 6) as ndcg, round(avg(coalesce(hits / relevant, 0)), 6) as recall, count(*) as n_queries
from (select distinct {parameter} from {source}) cross join ideal left join (
  select {parameter}, query_id, sum((pow(2.0, relevance) - 1) / log2(rank + 1)) as dcg, count(*) as hits from (select {parameter}, query_id, collection || '/' || path as doc, rank from {source}) join qrels using (query_id, doc) group by all)
  using ({parameter}, query_id) group by {parameter}"""


_TEXTS = "texts as (select distinct r.request_id as query_id, e.text from ranked_list r join eval_item e on r.query_id = e.item_id)"
_GAP = "greatest(coalesce(a, 0) - coalesce(b2, 0), 0)"
_TERMS = "list_filter(list_transform(string_split_regex(coalesce({0}, ''), '[^A-Za-z0-9]+'), lambda x: lower(x)), lambda x: length(x) >= 3 and x not in (" + ", ".join(f"'{w}'" for w in STOPWORDS) + "))"
_FEEDBACK = f"""with {_SCORES}, {_side('b', 'bm25_norm')}, {_TEXTS}, {_DOCS},
seeds as ({_top('b', evaluation.PRF_DOCS)}),
df as (select term, count(*) as df from (select unnest(list_distinct({_TERMS.format('body')})) as term from docs) group by term),
used as (select query_id, unnest({_TERMS.format('body')}) as term from seeds join docs using (collection, path)),
own as (select distinct query_id, unnest({_TERMS.format('text')}) as term from texts),
tf as (select query_id, term, count(*) as tf from used where not exists (select 1 from own where own.query_id = used.query_id and own.term = used.term) group by all),
terms as (select query_id, term, weight, term_rank from (select *, row_number() over (partition by query_id order by round(weight, 9) desc, term) as term_rank from (
  select query_id, term, tf * (ln(((select count(*) from docs) + 1.0) / (coalesce(df, 1) + 1.0)) + 1.0) as weight from tf left join df using (term))) where term_rank <= {evaluation.PRF_TERMS})"""
_SNAPSHOTS = """stored as (select collection, path, title, hash, created_at, modified_at, active = 1 as active from documents),
scanned as (select collection, path, title, case when doc_id % 10 = 1 then reverse(hash) else hash end as hash from documents where doc_id % 10 <> 0)"""
_DIFF = f"""with {_SNAPSHOTS}, both_sides as (
  select collection, path, s.hash as old_hash, n.hash as new_hash, s.there as s_there, n.there as n_there
  from (select *, 1 as there from stored where active) s full join (select *, 1 as there from scanned) n using (collection, path)),
changes as (select collection, path, old_hash, new_hash, case when s_there is null then 'add' when n_there is null then 'deactivate' when old_hash is distinct from new_hash then 'update' end as action from both_sides)"""
_RESULTS = "results as (select distinct collection, path, title, round(score, 3) + 0.0 as score, snippet, hash, doc_id from search_result where score is not null and not isnan(score))"
_CHUNKS = "select regexp_replace(hash_seq, '_[^_]*$', '') as hash, max(embedding) as embedding from vectors_vec where hash_seq is not null and len(embedding) = 64 group by hash_seq"
#: Every token of every searched field with its weight and place.
_TOKS = f"""select collection, path, field, w, unnest(l) as token, generate_subscripts(l, 1) as i from (
  select collection, path, 'p' as field, 10.0 as w, {_SPLIT.format('path')} as l from docs union all select collection, path, 't', 1.0, {_SPLIT.format('title')} from docs union all select collection, path, 'b', 1.0, {_SPLIT.format('body')} from docs)"""
_LENGTHS = f"select collection, path, len({_SPLIT.format('path')}) + len({_SPLIT.format('title')}) + len({_SPLIT.format('body')}) as size from docs"
#: ``found(query_id, collection, path, score)`` of ``ph(query_id, phrase_no, negated, prefix, t1, t2)``.
_BATCH = f"""toks as ({_TOKS}), lengths as ({_LENGTHS}), stats as (select collection, count(*) as docs, avg(size) as average from lengths group by collection),
begun as (select t1, token from (select distinct t1 from ph where prefix) p join (select distinct token from toks) t on starts_with(token, t1)),
met as (select query_id, phrase_no, negated, collection, path, w from ph join toks on token = t1 where not prefix and t2 is null
  union all select query_id, phrase_no, negated, collection, path, w from ph join begun using (t1) join toks using (token) where prefix
  union all select query_id, phrase_no, negated, x.collection, x.path, x.w from ph join toks x on x.token = t1 join toks y on y.collection = x.collection and y.path = x.path and y.field = x.field and y.i = x.i + 1 and y.token = t2 where t2 is not null),
per as (select query_id, phrase_no, negated, collection, path, sum(w) as f from met group by all),
dfs as (select query_id, phrase_no, collection, count(*) as df from per where not negated group by all),
raws as (select query_id, collection, path, count(*) as n, sum((case when ln((docs - df + 0.5) / (df + 0.5)) > 0 then ln((docs - df + 0.5) / (df + 0.5)) else 1e-6 end) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / average))) as raw
  from per join dfs using (query_id, phrase_no, collection) join stats using (collection) join lengths using (collection, path) where not negated group by all),
found as (select query_id, collection, path, raw / (1 + raw) as score from raws join (select query_id, count(*) as needed from ph where not negated group by query_id) using (query_id)
  where n = needed and not exists (select 1 from per x where x.negated and x.query_id = raws.query_id and x.collection = raws.collection and x.path = raws.path))"""
_COS = "list_cosine_similarity(embedding::double[], q)"
_BLANK = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"


def _trimmed(value: str) -> str:
    return rf"regexp_replace({value}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"



SQL: dict[str, str] = {
    "content_dedup": "select sha256(replace(text, chr(13) || chr(10), chr(10))) as text_hash, count(*) as copies, min(path) as first_path, epoch_us(min(created_at)) as created_us from documents where text is not null group by 1",
    "snapshot_diff": f"{_DIFF} select * from changes where action is not null",
    "update_counts": f"{_DIFF} select count(*) filter (action = 'add') as added, count(*) filter (action = 'update') as updated, count(*) filter (action = 'deactivate') as deactivated from changes",
    "updated_documents": f"""with {_SNAPSHOTS}, seen as (select distinct collection, true as scanned_too from scanned),
      j as (select collection, path, s.title, s.hash, s.created_at, s.modified_at, s.active, n.title as t2, n.hash as h2, n.there, scanned_too,
        n.there and not (s.hash is not distinct from n.hash and s.active is not distinct from true) as changed
        from stored s full join (select *, true as there from scanned) n using (collection, path) left join seen using (collection))
      select collection, path, case when changed then t2 else title end as title, case when changed then h2 else hash end as hash, epoch_us(coalesce(created_at, {NOW})) as created_us,
        epoch_us(case when changed then {NOW} else modified_at end) as modified_us, case when scanned_too and there is null then false when there then true else active end as active from j""",
    "new_content": f"select hash, length(min(text)) as n_chars, epoch_us({NOW}) as created_us from documents d where hash is not null and not exists (select 1 from content c where c.hash = d.hash and substr(c.hash, 1, 1) < '8') group by hash",
    "title_extract": f"""with t as (select doc_id, path, list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda l: regexp_replace(l, '\\r$', '')) as lines from documents where text is not null),
      f as (select *, case when lines[1] = '---' then coalesce(list_min(list_filter(range(2, len(lines) + 1), lambda i: lines[i] in ('---', '...'))), len(lines) + 1) else 0 end as fence from t),
      n as (select *, list_filter(list_transform(list_filter(lines[2:greatest(fence - 1, 1)], lambda l: starts_with(l, 'title:') or starts_with(l, 'name:')), lambda l: regexp_replace(regexp_replace({_trimmed("regexp_replace(l, '^(title|name):', '')")}, '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g')), lambda v: v <> '') as named,
        list_filter(list_transform(lines[fence + 1:], lambda l: {_trimmed('l')}), lambda v: v <> '') as rest from f)
      select doc_id, case when fence > 1 and len(named) > 0 then named[-1] when len(rest) > 0 then case when starts_with(rest[1], '# ') then {_trimmed('substr(rest[1], 3)')} else rest[1] end
        else regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]*$', '') end as title from n""",
    "unembedded": "select hash, min(path) as path from documents d where active = 1 and hash is not null and not exists (select 1 from content_vectors v where v.hash = d.hash) group by hash",
    "unembedded_by_model": "select hash, min(path) as path from documents d where active = 1 and hash is not null and not exists (select 1 from content_vectors v where v.hash = d.hash and v.model = 'embed-small-q8') group by hash",
    "orphaned_vectors": "select distinct hash from content_vectors v where hash is not null and not exists (select 1 from documents d where d.active = 1 and d.hash = v.hash)",
    "kept_vectors": "select distinct hash, seq, pos, model from content_vectors v where hash is null or exists (select 1 from documents d where d.active = 1 and d.hash = v.hash)",
    "upserted_chunk_map": """with n as (select hash, seq, max(pos + 1) as pos from chunk where hash is not null group by all), s as (select hash, seq, max(pos) as pos from content_vectors group by all)
      select * from s where not exists (select 1 from n where n.hash = s.hash and n.seq = s.seq) union all select * from n""",
    "collection_status": "select collection, count(*) as documents, sum(active)::bigint as active, round(sum(coalesce(octet_length(encode(text)), 0)) / 1048576, 1) as mib from documents group by collection",
    "term_df": f"with {_DOCS} select term, count(*) as df from (select unnest(list_distinct({_SPLIT.format('body')})) as term from docs) group by term",
    "bm25_multi_collection": _bm25([_RANKING, _SUMMARY]) + " select collection, path, round(score, 6) as score from (select *, row_number() over (partition by collection order by round(score, 9) desc, path) as r from found) where r <= 5",
    "bm25_batch": f"""with {_DOCS}, items as (select item_id as query_id, substr(item_id, -1, 1)::int % 3 as n, ts, list_filter(list_filter(ts, lambda x, i: list_position(ts, x) = i), lambda x: length(x) >= 6) as long
        from (select item_id, {_SPLIT.format('text')} as ts from eval_item where kind = 'query' and text is not null)),
      ph as (select query_id, unnest([1, 2]) as phrase_no, false as negated, false as prefix, unnest(long[1:2]) as t1, null::varchar as t2 from items where n = 0
        union all select query_id, 1, false, false, ts[3], ts[4] from items where n = 1 union all select query_id, 2, true, false, long[2], null from items where n = 1 and len(long) > 1
        union all select query_id, 1, false, true, long[1][1:4], null from items where n = 2 and len(long) > 0 union all select query_id, 2, false, true, long[2][1:3], null from items where n = 2 and len(long) > 1),
      {_BATCH}
      select {_OUT} from ({_top('found', 10)})""",
    "fulltext_index": f"""with {_DOCS}, toks as ({_TOKS}), lengths as ({_LENGTHS})
      select collection, docs, round(average, 6) as avg, postings, places from (select collection, count(*) as docs, avg(size) as average from lengths group by collection)
      join (select collection, count(*) as postings, sum(n)::bigint as places from (select collection, path, token, count(*) as n from toks group by all) group by collection) using (collection)""",
    "hybrid_pipeline": _bm25([_RANKING, _SUMMARY]) + f""", a as (select embedding::double[] as q from embeddings order by vec_id limit 1),
      direct as (select *, row_number() over (order by round(score, 9) desc, collection, path) as rank from (select *, row_number() over (partition by collection order by round(score, 9) desc, path) as r from found) where r <= 20),
      gate as (select a >= 0.75 and (b2 is null or a - b2 >= 0.10) as strong from (select max(score) filter (rank = 1) as a, max(score) filter (rank = 2) as b2 from direct)),
      b as (select * from (select *, row_number() over (partition by collection order by round(score, 9) desc, path) as r from found) where r <= 30),
      c as (select hash, {_COS} as score from ({_CHUNKS}) x, a where list_dot_product(embedding, embedding) > 0),
      places as (select collection, hash, min(path) as path from docs group by all),
      fetched as (select * from (select *, row_number() over (partition by collection order by round(score, 9) desc, hash) as r from c join places using (hash)) where r <= 120),
      v as (select * from (select *, row_number() over (partition by collection order by round(score, 9) desc, path) as r from (select collection, path, max(score) as score from fetched group by all)) where r <= 30),
      f as (select collection, path, 0.8 * coalesce(v.score, 0) + 0.2 * coalesce(b.score, 0) as score from (select collection, path, score from b) b full join v using (collection, path)),
      both_ways as (select collection, path, score from (select * from direct, gate where strong and rank <= 10) union all select collection, path, score from (select *, row_number() over (order by round(score, 9) desc, collection, path) as rank from f), gate where strong is not true and rank <= 10)
      select collection, path, round(score, 6) as score, '#' || substr(hash, 1, 6) as doc_id from both_ways join docs using (collection, path)""",
    "expanded_fusion": f"""with {_TWO}, typed as (select query_id, kind, collection, path, score * case kind when 'vec' then 1.5 else 1.0 end as score from scores where kind in ('lex', 'vec', 'hyde') and score_type in ('bm25_norm', 'cosine')),
      lexical as (select query_id, collection, path, score from typed where kind = 'lex' union all select * from b where query_id not in (select query_id from typed where kind = 'lex')),
      semantic as (select query_id, collection, path, score from typed where kind <> 'lex' union all select * from v where query_id not in (select query_id from typed where kind <> 'lex')),
      f as (select query_id, collection, path, 0.8 * coalesce(y.score, 0) + 0.2 * coalesce(x.score, 0) as score from (select query_id, collection, path, max(score) as score from lexical group by all) x full join (select query_id, collection, path, max(score) as score from semantic group by all) y using (query_id, collection, path))
      select {_OUT} from ({_top('f', 10)})""",
    "prf_fusion": f"""{_FEEDBACK}, ph as (select query_id, term_rank as phrase_no, false as negated, true as prefix, term as t1, null::varchar as t2 from terms where term_rank <= 2),
      {_BATCH}, again as ({_top('found', 30)}),
      f as (select query_id, collection, path, 0.7 * coalesce(b.score, 0) + 0.3 * coalesce(again.score, 0) as score from again full join b using (query_id, collection, path))
      select {_OUT} from ({_top('f', 10)})""",
    "corpus_jsonl": "select _id, md5(coalesce(title, '')) as title, md5(coalesce(text, '')) as text from corpus_doc",
    "queries_jsonl": "select item_id as query_id, text from eval_item where text is not null",
    "training_expansions": f"with {_TWO}, {_QRELS}, {_TEXTS} select query_id as qid, md5(text) as query, string_agg(doc, '|' order by doc) as relevant from qrels join texts using (query_id) group by query_id, text",
    "qrels_tsv": f"with {_TWO}, {_QRELS}, {_TEXTS} select query_id::varchar as query_id, doc, relevance, md5(text) as text from qrels join texts using (query_id)",
    "knn_topk": f"with e as (select vec_id, embedding from embeddings), a as (select embedding::double[] as q from e order by vec_id limit 1) select vec_id, round({_COS}, 6) as score from e, a order by round({_COS}, 9) desc, vec_id limit 10",
    "knn_batch": f"""select query_id, vec_id, round(score, 6) as score, rank from (select query_id, vec_id, score, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) as rank from (
      select query_id, vec_id, {_COS} as score from embeddings, (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id % 50 = 0) a)) where rank <= 10""",
    "vector_search": f"""with {_DOCS}, a as (select embedding::double[] as q from embeddings order by vec_id limit 1),
      c as (select hash, {_COS} as score from (select regexp_replace(hash_seq, '_[^_]*$', '') as hash, max(embedding) as embedding from vectors_vec where hash_seq is not null and len(embedding) = 64 group by hash_seq) x, a where list_dot_product(embedding, embedding) > 0),
      places as (select collection, hash, min(path) as path from docs group by all),
      fetched as (select * from (select *, row_number() over (partition by collection order by round(score, 9) desc, hash) as r from c join places using (hash)) where r <= 160)
      select collection, path, hash, round(score, 6) as score from (select collection, path, hash, max(score) as score from fetched group by all) order by round(score, 9) desc, collection, path limit 20""",
    "vector_width": "select len(embedding)::int as width, count(*) as n from vectors_vec group by 1",
    "l2_normalize": "select hash_seq, case when list_dot_product(embedding, embedding) > 0 then 1.0 else 0.0 end::double as length2 from (select distinct hash_seq, embedding from vectors_vec where embedding is not null)",
    "score_fusion": f"with {_TWO}, {_fused('f', 10)} select {_OUT} from f",
    "rrf_fusion": f"with {_SCORES}, {_LISTS}, f as (select query_id, collection, path, {_RRF} from lists where weight > 0 group by all) select {_OUT} from ({_top('f', 10)})",
    "subquery_rrf": f"""with {_TWO}, {_LISTS}, {_fused('f', 20)},
      every as (select query_id, collection, path, case kind when 'vec' then 1.5 else 1.0 end as weight, rank0 from lists where kind in ('lex', 'vec', 'hyde') union all select query_id, collection, path, 1.0, rank - 1 from f),
      s as (select query_id, collection, path, {_RRF} from every group by all) select {_OUT} from ({_top('s', 20)})""",
    "strong_signal_fused": f"with {_TWO}, {_fused('f', 10)} select query_id, a >= 0.40 and (b2 is null or a * (a - b2) >= 0.06) as strong from ({_PAIR.format('f')})",
    "strong_signal_bm25": f"with {_TWO}, f as ({_top('b', 100)}) select query_id, a >= 0.75 and (b2 is null or a - b2 >= 0.10) as strong from ({_PAIR.format('f')})",
    "min_score_limit": f"with {_TWO}, {_fused('f', 10)} select {_OUT} from f where score >= 0.5",
    "adaptive_alpha": f"""with {_TWO}, {_TEXTS}, rb as ({_top('b', 100)}), rv as ({_top('v', 100)}), gb as (select query_id, {_GAP} as g from ({_PAIR.format('rb')})), gv as (select query_id, {_GAP} as g from ({_PAIR.format('rv')}))
      select query_id, round(greatest(0.55, least(0.95, 0.8 + 0.15 * (coalesce(gv.g, 0) - coalesce(gb.g, 0)) / 0.2 + case when n <= 3 then -0.05 when n >= 8 then 0.03 else 0 end)), 6) as alpha
      from (select query_id, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) as n from texts) left join gb using (query_id) left join gv using (query_id)""",
    "rerank_blend": f"""with {_TWO}, {_side('y', 'yesno')}, {_fused('f', 20)},
      r as (select query_id, collection, path, case when y.score is null then f.score else 0.4 * f.score + 0.6 * y.score end as score from f left join y using (query_id, collection, path)) select {_OUT} from ({_top('r', 10)})""",
    "rerank_cache_split": f"""with {_TWO}, {_TEXTS}, {_fused('f', 20)},
      k as (select query_id, sha256('judge' || chr(0) || lower(trim(text)) || chr(0) || hash) as key from f join (select collection, path, hash from documents where hash is not null) using (collection, path) join texts using (query_id))
      select query_id, count(*) filter (substr(key, 1, 1) < '8') as hits, count(*) filter (substr(key, 1, 1) >= '8') as misses from k group by query_id""",
    "cache_keys": "select item_id, sha256('expander' || chr(0) || lower(trim(text))) as expander_key, sha256('judge' || chr(0) || lower(trim(text)) || chr(0) || item_id) as rerank_key from eval_item where text is not null",
    "query_expansion": """with q as (select item_id as query_id, text, substr(item_id, -1, 1)::int % 3 as n, string_split(text, ' ')[1] as w from eval_item where kind = 'query' and text is not null)
      select query_id, 0 as seq, 'lex' as kind, case when n = 0 then w else text end as text from q union all select query_id, 1, 'vec', case when n = 0 then 'a b' else text end from q
      union all select query_id, 2, 'hyde', 'Information about ' || text from q where n <> 0""",
    "prompts": """select distinct _id, md5('title: ' || coalesce(title, '') || ' | text: ' || text) as document, md5('Represent this sentence: ' || coalesce(title, '')) as query,
      md5(case when coalesce(title, '') = '' then text else title || chr(10) || chr(10) || text end) as plain from corpus_doc where text is not null""",
    "ndcg_recall": f"with {_TWO}, {_fused('f', 10)}, {_QRELS}, {_metrics('m', 'f')} select query_id, round(ndcg, 6) as ndcg, round(recall, 6) as recall from m",
    "mean_metrics": f"with {_TWO}, {_fused('f', 10)}, {_QRELS}, {_metrics('m', 'f')} select round(avg(ndcg), 6) as ndcg, round(avg(recall), 6) as recall, count(*) as n_queries from m",
    "paired_t_test": f"""with {_TWO}, {_fused('f', 10)}, {_fused('g', 10, 0.3)}, {_QRELS}, {_metrics('m', 'f')}, {_metrics('o', 'g')},
      s as (select count(*) as n, avg(o.ndcg - m.ndcg) as d, stddev_samp(o.ndcg - m.ndcg) / sqrt(count(*)) as e from m join o using (query_id))
      select n, round(d, 6) as mean_diff, round(e, 6) as se, round(case when e > 0 then d / e else 0 end, 6) as t, round(d - 1.96 * e, 6) as low, round(d + 1.96 * e, 6) as high, abs(case when e > 0 then d / e else 0 end) >= 1.96 as significant from s where n >= 2""",
    "tune_alpha": f"""with {_TWO}, {_QRELS}, g as (select unnest([{', '.join(f'{a}::double' for a in evaluation.ALPHAS)}]) as alpha),
      r_all as (select alpha, query_id, collection, path, alpha * coalesce(v.score, 0) + (1 - alpha) * coalesce(b.score, 0) as score from (b full join v using (query_id, collection, path)) cross join g),
      r as ({_top('r_all', 10, 'alpha, query_id')}) {_grid('alpha', 'r')}""",
    "tune_rerank": f"""with {_TWO}, {_QRELS}, {_side('lg', 'logit')}, {_fused('f', 20)}, g as (select unnest([{', '.join(f'{a}::double' for a in evaluation.RERANK_WEIGHTS)}]) as weight),
      r_all as (select weight, query_id, collection, path, case when lg.score is null then f.score else (1 - weight) * f.score + weight * (1.0 / (1.0 + exp(-lg.score))) end as score from (f left join lg using (query_id, collection, path)) cross join g),
      r as ({_top('r_all', 10, 'weight, query_id')}) {_grid('weight', 'r')}""",
    "prf_terms": f"{_FEEDBACK} select query_id, term, round(weight, 6) as weight, term_rank from terms",
    "prf_queries": f"{_FEEDBACK} select query_id, text || ' ' || more as text from texts join (select query_id, string_agg(term, ' ' order by term_rank) as more from terms group by query_id) using (query_id)",
    "output_csv": f"""with {_RESULTS} select q(collection) || ',' || q(path) || ',' || q(coalesce(title, '')) || ',' || printf('%.4f', score) || ',' || doc_id as line from results""".replace(
        "q(collection)", "(case when regexp_matches(collection, '[,\"\\n]') then '\"' || replace(collection, '\"', '\"\"') || '\"' else collection end)"
    ).replace("q(path)", "(case when regexp_matches(path, '[,\"\\n]') then '\"' || replace(path, '\"', '\"\"') || '\"' else path end)").replace(
        "q(coalesce(title, ''))", "(case when regexp_matches(coalesce(title, ''), '[,\"\\n]') then '\"' || replace(title, '\"', '\"\"') || '\"' else coalesce(title, '') end)"
    ),
    "output_json": "select distinct to_json({'collection': collection, 'path': path, 'title': title, 'score': score, 'snippet': snippet, 'hash': hash, 'doc_id': doc_id})::varchar as line from (select distinct collection, path, title, round(score, 3) + 0.0 as score, snippet, hash, doc_id from search_result where score is not null and not isnan(score))".replace("select distinct to_json", "select to_json"),
    "output_markdown": f"with {_RESULTS} select '- [' || coalesce(title, '') || '](' || path || ') `' || printf('%.3f', score) || '` ' || doc_id || case when snippet is null then '' else chr(10) || '  > ' || replace(replace(snippet, '<b>', '**'), '</b>', '**') end as line from results",
    "p7_found": "select distinct doc_id from documents d where active = 1 and hash is not null and not exists (select 1 from content_vectors v where v.hash = d.hash and v.embedded_at is not null)",
    "p7_pending": """with last as (select max(started_at) as l from index_run where status = 'ok' and finished_at is not null),
      since as (select min(started_at) as s from index_run, last where started_at <= l and (finished_at is null or finished_at > l))
      select distinct doc_id, hash, epoch_us(modified_at) as modified_us, modified_at is null or s is null or modified_at >= s as reread from documents d, since
      where active = 1 and hash is not null and not exists (select 1 from content_vectors v where v.hash = d.hash and v.embedded_at is not null)""",
}
_NOT = [_RANKING, fulltext.Phrase(("calibrated",), negated=True), fulltext.Phrase(("stale",), negated=True)]
SQL |= {
    "bm25_terms": _search([_RANKING, _SUMMARY]),
    "bm25_prefix": _search([fulltext.Phrase(("calib",), True), fulltext.Phrase(("rank",), True)]),
    "bm25_phrase": _search([fulltext.Phrase(("the", "vector"))]),
    "bm25_not": _search(_NOT),
    "bm25_scan": _search(_NOT),
    # The words of the tables that have the two stems.
    "bm25_porter": _search([fulltext.Phrase(("rank",)), fulltext.Phrase(("calibr",))], split=_SPLIT.replace("lower(coalesce({0}, ''))", "strip_accents(lower(coalesce({0}, '')))"), stems={"rank": "rank(s|ed|ing|ings)?", "calibr": "calibrat(e|es|ed|ing|ion|ions|or|ors)"}),
    "bm25_title_weight": _search([fulltext.Phrase(("ranking",), True)], title_weight=3.0),
    "bm25_min_score": _search([fulltext.Phrase(("ranking",), True)], min_score=0.5),
}

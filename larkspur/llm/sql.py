"""SQL twins of the subpackage's queries, for DuckDB over the same tables.

Left out are those whose result no SQL over whole tables gives: token ids, chosen pieces, clean text,
the approximate neighbour lists and edit distances.  The tests compare these with brute force.
"""

from __future__ import annotations

_LETTERS = r"'[^\p{L}\p{N}]+', '', 'g'"
_FRONT = r"'^\x{FEFF}?---[ \t\r]*\n'"


def _fold(x: str) -> str:
    return f"regexp_replace(replace(lower({x}), 'ς', 'σ'), {_LETTERS})"


_FORMS = f"""lined as (select hash, doc, string_split(doc, chr(10)) as ls from content where hash is not null and doc is not null),
fenced as (select *, case when regexp_matches(doc, {_FRONT}) then list_min(list_filter(range(2, len(ls) + 1), lambda i: regexp_matches(ls[i], '^---[ \\t\\r]*$'))) end as stop from lined),
forms as (select distinct hash, case when stop is null then {_fold('doc')}
  else array_to_string(list_sort(list_transform(ls[2:stop - 1], lambda l: {_fold('l')})), '') || {_fold("array_to_string(ls[stop + 1:], chr(10))")} end as form from fenced)"""
_RANKED = """lists as (select request_id, list_no, arg_max(weight, logged_at) as weight, arg_max(better, logged_at) as better from ranked_list group by all),
best as (select s.request_id, s.list_no, collection, path, weight, max(case when better = 'lower' then -score else score end) as good
  from search_result s join lists l on s.request_id = l.request_id and s.list_no = l.list_no where weight > 0 and score is not null and not isnan(score) and collection is not null and path is not null group by all),
ranked as (select *, rank() over (partition by request_id, list_no order by good desc) as r from best),
totals as (select request_id, collection, path, list_sum(list(weight / (60 + r) order by list_no)) as score, min(r) as best from ranked group by all),
final as (select *, row_number() over (partition by request_id order by score desc, best, collection, path) as rank from totals)"""
_WORDS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
_SHINGLES = f"""words as (select hash, {_WORDS.format('doc')} as w from (select hash, min(doc) as doc from content where hash is not null and doc is not null group by hash)),
runs as (select distinct hash, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as s from words where len(w) >= 3),
sizes as (select hash, count(*) as n from runs group by hash),
shared as (select a.hash as hash_a, b.hash as hash_b, count(*) as c from runs a join runs b on a.s = b.s and a.hash < b.hash group by all)"""
_PARTS = f"""items as (select item_id, w, least(len(w), 12)::int as k from (select item_id, {_WORDS.format('text')} as w from eval_item where text is not null)),
parts as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as s from (select *, unnest(range(1, len(w) - k + 2)) as i from items where k > 0)),
docs as (select doc_id, {_WORDS.format('text')} as w from documents where text is not null)"""
# The twin's own tables: what the test tables hold, written down apart from the operator's.
_INVISIBLE = r"[\x{AD}\x{34F}\x{61C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FE00}-\x{FE0F}\x{FEFF}]"
_CYRILLIC = ("АВЕЅІЈКМНОРСТХУаеѕіјорсхуһԁԛԝ", "ABESIJKMHOPCTXYaesijopcxyhdqw")
_GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγικνορυχ", "ABEZHIKMNOPTYXayikvopux")
_FROM, _TO = _CYRILLIC[0] + _GREEK[0], _CYRILLIC[1] + _GREEK[1]
#: Width forms of ASCII, ligatures and space characters: what the test tables hold.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_ASCII = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))
_BASE = r"regexp_replace(regexp_replace(text, '" + _INVISIBLE + r"', '', 'g'), '[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]', ' ', 'g')"
for _one, _many in _LIGATURES:
    _BASE = f"replace({_BASE}, '{_one}', '{_many}')"
_LOOK = f"nfc_normalize(translate(translate(nfc_normalize({_BASE}), '{_WIDE}', '{_ASCII}'), '{_FROM}', '{_TO}'))"

SQL: dict[str, str] = {
    "p1_found": f"with {_FORMS} select a.hash as hash_a, b.hash as hash_b from forms a join forms b on a.form = b.form and a.hash < b.hash where a.form <> ''",
    "p1_groups": f"with {_FORMS} select min(hash) as representative, count(*) as copies, false as collided from forms where form <> '' group by form",
    "p2_found": f"with {_RANKED} select request_id, collection, path from final where rank = 1",
    "p2_ranking": f"with {_RANKED} select request_id, collection, path, round(score, 9) as score, rank from final",
    "p3_found": """with v as (select hash_seq, any_value(embedding)::double[] as e from vectors_vec where hash_seq is not null and len(embedding) = 64 group by hash_seq having list_dot_product(any_value(embedding), any_value(embedding)) > 0),
      s as (select a.hash_seq as a, b.hash_seq as b, list_cosine_similarity(a.e, b.e) as c from v a join v b on a.hash_seq <> b.hash_seq where list_cosine_similarity(a.e, b.e) >= 0.9),
      r as (select a, b, rank() over (partition by a order by c desc) as r from s)
      select x.a as hash_seq_a, x.b as hash_seq_b from r x join r y on x.a = y.b and x.b = y.a where x.a < x.b and x.r <= 5 and y.r <= 5""",
    "p4_found": """with docs as (select distinct hash, string_split(doc, chr(10)) as ls from content where hash is not null and octet_length(encode(doc)) > 2048),
      front as (select *, case when regexp_matches(ls[1], '^\\x{FEFF}?---[ \\t\\r]*$') then coalesce(list_min(list_filter(range(2, len(ls) + 1), lambda i: regexp_matches(ls[i], '^---[ \\t\\r]*$'))), 0) else 0 end as stop from docs),
      marks as (select hash, ls, stop, list_transform(range(1, len(ls) + 1), lambda i: case when i > stop and (starts_with(ls[i], '```') or starts_with(ls[i], '~~~')) then ls[i][1:3] else '' end) as ms from front),
      fences as (select *, list_reduce(list_prepend({'open': '', 'inside': []::varchar[]}, list_transform(ms, lambda m: {'open': m, 'inside': []::varchar[]})),
        lambda s, m: {'open': case when s.open = '' then m.open when m.open = s.open then '' else s.open end, 'inside': list_append(s.inside, s.open)}).inside as inside from marks),
      lines as (select hash, ls[i] as l, i, stop, inside[i] as fence, sum(octet_length(encode(ls[i])) + 1) over (partition by hash, ls order by i) - octet_length(encode(ls[i])) - 1 as pos from (select *, unnest(range(1, len(ls) + 1)) as i from fences))
      select distinct hash, pos::bigint as pos from lines where pos > 0 and i > stop and fence = '' and regexp_matches(l, '^#{1,6} ')""",
    "p6_found": f"with {_SHINGLES} select hash_a, hash_b from shared join sizes x on x.hash = hash_a join sizes y on y.hash = hash_b where c >= 0.6 * (x.n + y.n - c)",
    "p6_groups": f"""with recursive words as (select hash, w, array_to_string(w, ' ') as c from (select hash, {_WORDS.format('doc')} as w from (select hash, min(doc) as doc from content where hash is not null and doc is not null group by hash)) where len(w) >= 5),
      classes as (select c, min(hash) as rep, count(*) as copies from words group by c),
      runs as (select distinct hash, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as s from words where hash in (select rep from classes)),
      sizes as (select hash, count(*) as n from runs group by hash),
      shared as (select a.hash as a, b.hash as b, count(*) as c from runs a join runs b on a.s = b.s and a.hash < b.hash group by all),
      edges as (select a, b from shared join sizes x on x.hash = a join sizes y on y.hash = b where c >= 0.8 * (x.n + y.n - c)),
      ways as (select a, b from edges union all select b, a from edges),
      reach as (select a as x, a as y from ways union select r.x, w.b from reach r join ways w on w.a = r.y),
      groups as (select x as rep, min(y) as component from reach group by x), degrees as (select a as rep, count(*) as links from ways group by a),
      found as (select hash, coalesce(component, case when copies > 1 then rep end) as group_id, coalesce(links, 0) as links, copies from words join classes using (c) left join groups using (rep) left join degrees using (rep))
      select hash, group_id, links, copies, collection, path from found left join (select distinct hash, collection, path from documents) using (hash) where group_id is not null""",
    "p9_found": f"""with {_PARTS}, ks as (select distinct k from items where k > 0),
      runs as (select distinct doc_id, k, s from (select doc_id, k, array_to_string(w[i:i + k - 1], ' ') as s from (select *, unnest(range(1, len(w) - k + 2)) as i from docs, ks)) where s in (select s from parts))
      select distinct doc_id, item_id from runs join parts using (k, s)""",
    "p10_found": f"""with forms as (select doc_id, text, {_LOOK} as look from documents where text is not null)
      select a.doc_id as doc_id_a, b.doc_id as doc_id_b from forms a join forms b on a.look = b.look and a.doc_id < b.doc_id where a.text <> b.text and regexp_matches(a.look, '\\S')""",
}

"""DuckDB SQL for the core queries, over the whole tables."""

from __future__ import annotations

from vellum.functions.text import LATIN_STAND_IN, LOOK_ALIKE, ZERO_WIDTH
from vellum.operators.graph import AMENDMENT_PROPERTIES, DOCUMENT_PROPERTIES, UNIT_PROPERTIES

_FORM = LOOK_ALIKE | LATIN_STAND_IN | {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_PLAIN = "".join(_FORM.values()).replace("'", "''")


_INVISIBLE = "".join(rf"\x{{{ord(c):x}}}" if c != "-" else "-" for c in ZERO_WIDTH)


def form(column: str) -> str:
    """Nothing invisible, look-alikes and full-width letters as plain ones, composed."""
    return f"translate(regexp_replace(nfc_normalize({column}), '[{_INVISIBLE}]', '', 'g'), '{''.join(_FORM)}', '{_PLAIN}')"


def _key(column: str) -> str:
    return f"upper(trim({form(column)}))"


UNITS = "u as (select * exclude (n) from (select *, row_number() over (partition by unit_id order by loaded_at desc) n from legal_units where unit_id is not null) where n = 1)"
DOCS = "d as (select distinct * from legal_documents)"
QUESTIONS = "q as (select distinct * from gold_questions)"
RELATIONS = "r as (select distinct * from relations)"
CANDIDATES = "c as (select distinct * from candidates)"
ASKED = "asked as (select * from q where cast(regexp_extract(question_id, '(\\d+)$', 1) as bigint) % 20 = 0)"
RANKING = """ranking as (select question_id query_id, unit_id, document_id, cast(row_number() over (partition by question_id order by exact_rank asc nulls last,
    lexical_rank asc nulls last, dense_rank asc nulls last, unit_id, candidate_id) as integer) rank from c)"""
TOKENS = "regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+')"
BLANKS = "trim(regexp_replace(nfc_normalize({0}), '[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))"
QUERIES_SQL = f"asked_text as (select question_id query_id, {BLANKS.format('question')} query from asked)"
BM25 = f"""
toks as (select unit_id, {TOKENS.format("coalesce(text, '')")} t from u),
stats as (select count(*) n, round(avg(len(t)), 6) mean from toks),
post as (select unit_id, size, term, count(*) tf from (select unit_id, len(t) size, unnest(t) term from toks) group by all),
dfs as (select term, count(*) df from post group by 1),
qt as (select query_id, unnest(list_distinct({TOKENS.format("query")})) term from asked_text),
bm as (select query_id, unit_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) lexical_score
    from qt join post using (term) join dfs using (term) cross join stats group by 1, 2),
top as (select *, cast(row_number() over (partition by query_id order by lexical_score desc, unit_id) as integer) lexical_rank from bm)"""
CASES = """cases as (select question_id, {recalls},
    coalesce(1.0 / list_min(list_filter(list_transform(list_distinct(gold_unit_ids), lambda x: list_position(us[1:10], x)), lambda x: x > 0)), 0.0) reciprocal_rank,
    case when len(list_intersect(list_distinct(gold_unit_ids), us[1:10])) = len(list_distinct(gold_unit_ids)) then 'full_hit'
        when len(list_intersect(list_distinct(gold_unit_ids), us[1:10])) > 0 then 'partial_hit' else 'miss' end status
    from {questions} left join (select query_id, list(unit_id order by rank) us_, list(document_id order by rank) ds_ from {ranking} group by 1) on query_id = question_id
    , lateral (select coalesce(us_, []) us, coalesce(ds_, []) ds) where len(gold_unit_ids) > 0 and len(gold_document_ids) > 0)"""
_RECALLS = ", ".join(
    f"len(list_intersect(list_distinct({gold}), {ranked}[1:{k}]))::double / len(list_distinct({gold})) {kind}_recall_{k}"
    for kind, gold, ranked in (("unit", "gold_unit_ids", "us"), ("document", "gold_document_ids", "ds"))
    for k in (1, 3, 5, 10)
)
_METRICS = "count(*) questions, " + ", ".join(f"round(avg({kind}_recall_{k}), 9) {kind}_recall_{k}" for kind in ("unit", "document") for k in (1, 3, 5, 10)) + ", round(avg(reciprocal_rank), 9) mrr_10, " + ", ".join(f"count(*) filter (status = '{s}') {s}" for s in ("full_hit", "partial_hit", "miss"))
_PKEY = "concat_ws('::', snapshot_id, {0})"
NODES = f"""nodes as (
    select distinct 'Snapshot' label, snapshot_id "key" from (select snapshot_id from d union select snapshot_id from u) where snapshot_id is not null
    union all select 'Document', {_PKEY.format("document_id")} from d
    union all select distinct 'DocumentType', portal_document_type from d where portal_document_type is not null
    union all select distinct 'EffectStatus', source_effect_status from d where source_effect_status is not null
    union all select distinct 'Field', f from (select unnest(fields) f from d union select unnest(majors) f from d) where f is not null
    union all select distinct 'Organization', f from (select unnest(issuing_organs) f from d) where f is not null
    union all select distinct 'Signer', f.name from (select unnest(signers) f from d) where f.name is not null
    union all select upper(unit_type[1]) || unit_type[2:], {_PKEY.format("unit_id")} from u)"""
METADATA = f"""metadata as (
    select 'HAS_TYPE' type, {_PKEY.format("document_id")} src, portal_document_type dst, cast(null as varchar) extra from d where portal_document_type is not null
    union all select 'HAS_STATUS', {_PKEY.format("document_id")}, source_effect_status, null from d where source_effect_status is not null
    union all select 'IN_FIELD', src, f, string_agg(s, ',' order by s) from (select {_PKEY.format("document_id")} src, unnest(fields) f, 'fields' s from d union select {_PKEY.format("document_id")}, unnest(majors), 'majors' from d) where f is not null group by 2, 3
    union all select distinct 'ISSUED_BY', src, f, null from (select {_PKEY.format("document_id")} src, unnest(issuing_organs) f from d) where f is not null
    union all select 'SIGNED_BY', src, f.name, max(f.job_title) from (select {_PKEY.format("document_id")} src, unnest(signers) f from d) where f.name is not null group by 2, 3)"""
TREE = f"""tree as (
    select 'HAS_' || upper(unit_type) type, {_PKEY.format("document_id")} src, {_PKEY.format("unit_id")} dst from u where parent_id is null
    union all select 'HAS_' || upper(unit_type), {_PKEY.format("parent_id")}, {_PKEY.format("unit_id")} from u where parent_id in (select unit_id from u))"""
AMENDS = f"""am as (select distinct {_PKEY.format("coalesce(source.unit_id, source.document_id)")} src, {_PKEY.format("coalesce(target.unit_id, target.document_id)")} dst, relation_id from r where relation_type = 'AMENDS'),
    ends as (select {_PKEY.format("document_id")} e from d union select {_PKEY.format("unit_id")} from u),
    amends as (select * from am where src in (select e from ends) and dst in (select e from ends))"""
EDGES = f"""edges as (
    select 'IN_SNAPSHOT' type, {_PKEY.format("document_id")} src, snapshot_id dst from d union all select 'IN_SNAPSHOT', {_PKEY.format("unit_id")}, snapshot_id from u
    union all select * from tree union all select type, src, dst from metadata union all select 'AMENDS', src, dst from amends)"""
_TYPES = ("part", "chapter", "section", "article", "clause", "point")
LOCATOR = """loc as (select relation_id query_id, target.document_id document_id, target.unit_id target_unit, nullif(regexp_extract(target.unit_id, '::article::([^:]+)', 1), '') article,
    nullif(regexp_extract(target.unit_id, '::clause::([^:]+)', 1), '') clause, nullif(regexp_extract(target.unit_id, '::point::([^:]+)', 1), '') point from r where target.unit_id is not null)"""
LOCATOR_TEXT = """asked_text as (select query_id, concat_ws(' ', 'Nội dung', 'điểm ' || point, 'khoản ' || clause, 'Điều ' || article, 'của văn bản số', document_id) query from loc)"""
SCOPED_BM25 = BM25.replace("from qt join post using (term)", "from qt join post using (term) join u using (unit_id) join loc using (query_id)").replace("cross join stats group by", "cross join stats where u.document_id = loc.document_id group by")
MERGED = """j as (select coalesce(e.query_id, t.query_id) query_id, coalesce(e.unit_id, t.unit_id) unit_id, exact_rank, lexical_rank, lexical_score from exact e full join (select * from top where lexical_rank <= 15) t on e.query_id = t.query_id and e.unit_id = t.unit_id),
    k as (select *, cast(row_number() over (partition by query_id order by exact_rank asc nulls last, lexical_rank asc nulls last) as integer) rank from j)"""
EXACT = """exact as (select query_id, unit_id, u.document_id, cast(row_number() over (partition by query_id order by unit_id) as integer) exact_rank from loc join u on unit_id = target_unit)"""


def _with(*parts: str) -> str:
    return "with " + ", ".join(parts) + " "


def _manifest(back: int, *columns: str) -> str:
    """The last delivery of each document in the last snapshot or one before; of several at one time the fullest, then the largest."""
    order = "delivered_at desc nulls last, " + ", ".join(f"({c} is not null) desc" for c in columns) + ", " + ", ".join(f"{c} desc" for c in columns)
    named = f"(select snapshot_id from snapshots order by taken_at desc, snapshot_id desc limit 1 offset {back})"
    formed = f"(select * replace ({_key('document_id')} as document_id, {_key('content_sha256')} as content_sha256) from manifest_entries where snapshot_id = {named} and document_id is not null)"
    return f"(select snapshot_id, document_id, {', '.join(columns)} from {formed} qualify row_number() over (partition by document_id order by {order}) = 1)"


def _code(code: str, table: str, key: str, test: str) -> str:
    return f"select {key}, '{code}' code from {table} where coalesce({test}, true)"


def _unpivot(label: str, key: str, columns: tuple[str, ...], rows: str) -> str:
    """A row for each property that isn't null; a list is its parts with blanks between."""
    pairs = ", ".join(f"{{'property': '{c}', 'value': {'array_to_string(path, chr(32))' if c == 'path' else f'cast({c} as varchar)'}}}" for c in columns)
    return f"select label, \"key\", x.property, x.value from (select {label} label, {key} \"key\", unnest([{pairs}]) x from {rows}) where x.value is not null"


def _json(path: str) -> str:
    return f"json_extract_string(payload, '$.{path}')"


def _held(path: str) -> str:
    """A value under data that is no object and not blank."""
    return f"case when coalesce(json_type(payload, '$.data.{path}'), 'NULL') not in ('NULL', 'OBJECT') then nullif(trim(json_extract_string(payload, '$.data.{path}')), '') end"


def _kind(path: str) -> str:
    return f"coalesce(json_type(payload, '$.{path}'), 'NULL')"


def _names(path: str, name: str) -> str:
    """Distinct names of a list of objects, in order."""
    return f"(select coalesce(array_to_string(list(n order by i), '; '), '') from (select n, min(i) i from (select unnest(json_extract_string(payload, '$.data.{path}[*].{name}')) n, unnest(range(len(json_extract_string(payload, '$.data.{path}[*].{name}')))) i) where n is not null group by 1))"


_DAY = "'^[0-9]{4}-[0-9]{2}-[0-9]{2}(T00:00(:00(\\.0+)?)?(Z|[+-]00:00)?)?$'"
_VALID = " and ".join([
    f"{_kind('success')} = 'BOOLEAN'", f"{_json('success')} = 'true'", f"{_kind('tabName')} = 'VARCHAR'",
    *(f"{_kind('data.' + c)} = 'VARCHAR' and trim({_json('data.' + c)}) <> ''" for c in ("docGUId", "docIdentity", "docName", "docContent")),
    *(f"({_kind('data.' + c)} = 'NULL' or {_kind('data.' + c)} = 'VARCHAR' and ({_json('data.' + c)} = '' or regexp_matches({_json('data.' + c)}, {_DAY}) and try_cast({_json('data.' + c)}[1:10] as date) is not null))" for c in ("issueDate", "effectDate", "expireDate")),
    *(f"({_kind('data.' + c)} = 'NULL' or {_kind('data.' + c)} = 'OBJECT' and {_kind(f'data.{c}.{n}')} = 'VARCHAR')" for c, n in (("effectStatus", "effectStatusName"), ("docType", "docTypeName"))),
    *(f"({_kind('data.' + c)} = 'NULL' or {_kind('data.' + c)} = 'ARRAY' and len(list_filter(json_extract(payload, '$.data.{c}[*]'), lambda x: json_type(x) <> 'OBJECT')) = 0)" for c in ("fields", "majors", "organs", "signers")),
])
RESPONSES = f"""p as (select distinct record_id, payload from portal_records), j as (select * from p where payload is not null and json_valid(payload)),
    ok as (select * from j where coalesce({_VALID}, false))"""

#: Fields of valid payloads, read from the statement: every path whose value is neither null nor an object, lists of
#: objects included; elements of a list are no fields themselves, but the keys of objects in it are.
FLAT = """p as (select distinct feed, file_no, file_name, payload from portal_records where payload is not null and json_valid(payload) and feed is not null and file_no is not null),
    fl as (select feed, file_no, md5(payload) pid, json_extract_string(payload, '$.data.docGUId') doc, regexp_replace(fullkey[3:], '\\[[0-9]+\\]', '', 'g') path, id,
        case type when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' else 'number' end kind,
        case type when 'VARCHAR' then json_extract_string(payload, fullkey) when 'ARRAY' then cast(json_extract(payload, fullkey) as varchar) else cast(value as varchar) end val
        from p, json_tree(payload) where type not in ('NULL', 'OBJECT') and fullkey not like '%]'),
    fields as (select distinct feed, file_no, path, kind from fl),
    files as (select feed, file_no, max(file_name) file_name, row_number() over (partition by feed order by file_no) n, lag(file_no) over (partition by feed order by file_no) before, count(*) over (partition by feed) last
        from portal_records where feed is not null and file_no is not null group by feed, file_no)"""

_P1 = f"""with o as (select snapshot_id, row_number() over (order by taken_at, snapshot_id) n from snapshots),
        m as (select n, {_key("document_id")} document_id, {_key("content_sha256")} h, parser_version p from manifest_entries join o using (snapshot_id) where document_id is not null
            qualify row_number() over (partition by n, {_key("document_id")} order by delivered_at desc nulls last, (content_sha256 is not null) desc, (parser_version is not null) desc, {_key("content_sha256")} desc, parser_version desc) = 1),
        j as (select coalesce(a.n, b.n + 1) n, coalesce(a.document_id, b.document_id) document_id,
            case when b.n is null then 'added' when a.n is null then 'removed' when a.h is distinct from b.h or a.p is distinct from b.p then 'changed' end change
            from m a full join m b on a.document_id = b.document_id and a.n = b.n + 1)"""

ORACLES: dict[str, str] = {
    "p1_found": _P1 + " select snapshot_id, document_id, change from j join o using (n) where change is not null and n > 1",
    "p1_counts": _P1 + " select snapshot_id, " + ", ".join(f"count(*) filter (change = '{c}') {c}" for c in ("added", "removed", "changed")) + " from j join o using (n) where change is not null and n > 1 group by 1",
    "p5_lifespans": _with(FLAT, "x as (select feed, path, kind, file_no, n, last, n - row_number() over (partition by feed, path, kind order by n) island from fields join files using (feed, file_no))")
    + "select feed, path, kind \"type\", min(file_no) first_file, max(file_no) last_file, count(*) files, max(n) = max(last) open_end from x group by feed, path, kind, island",
    "p5_found": _with(FLAT,
        "sets as (select feed, file_no, path, string_agg(kind, ',' order by kind) kinds from fields group by 1, 2, 3)",
        "a as (select f.feed, f.file_no later, f.before, f.file_name, x.path, x.kinds from files f join sets x on x.feed = f.feed and x.file_no = f.before)",
        "b as (select f.feed, f.file_no later, f.before, f.file_name, x.path, x.kinds from files f join sets x using (feed, file_no) where f.before is not null)",
        "gone as (select * from a where not exists (select 1 from b where b.feed = a.feed and b.later = a.later and b.path = a.path))",
        "born as (select * from b where not exists (select 1 from a where b.feed = a.feed and b.later = a.later and b.path = a.path))",
        "vals as (select feed, file_no, doc, path, string_agg(distinct v, chr(1) order by v) v from (select feed, file_no, doc, path, pid, string_agg(val, chr(2) order by id) v from fl where doc is not null group by all) group by 1, 2, 3, 4)",
        """renamed as (select g.feed, g.later, g.file_name, g.path o, n.path w from gone g join born n on n.feed = g.feed and n.later = g.later join vals x on x.feed = g.feed and x.file_no = g.before and x.path = g.path
            join vals y on y.feed = g.feed and y.file_no = g.later and y.path = n.path and y.doc = x.doc group by all having bool_and(x.v = y.v))""")
    + """select file_name, 'renamed' change, o old_path, w new_path from renamed union select file_name, 'removed', path, '' from gone g where not exists (select 1 from renamed r where r.feed = g.feed and r.later = g.later and r.o = g.path)
        union select file_name, 'added', '', path from born g where not exists (select 1 from renamed r where r.feed = g.feed and r.later = g.later and r.w = g.path)
        union select b.file_name, 'retyped', b.path, b.path from a join b on a.feed = b.feed and a.later = b.later and a.path = b.path where a.kinds <> b.kinds""",
    # every name under which a field is delivered, read off the payloads
    "p5_filled": "with p as (select distinct record_id, feed, file_no, payload from portal_records where payload is not null and json_valid(payload)) select feed, count(*) records, " + ", ".join(
        f"count(coalesce({', '.join(_held(x) for x in names)})) {c}" for c, names in {
            "guid": ["docGUId"], "identity": ["docIdentity"], "name": ["docName"], "content": ["docContent.html", "docContent", "content", "noiDung", "htmlContent", "body.value"],
            "effect_status": ["effectStatus.effectStatusName", "effectStatus.name", "effectStatusName", "effectStatus"], "issue_date": ["issueDate", "issue_date", "issuedDate", "ngayBanHanh"], "effect_date": ["effectDate"],
            "expire_date": ["expireDate"], "doc_type": ["docType.docTypeName"], "fields": ["fields[0].fieldName"], "majors": ["majors[0].majorName"], "organs": ["organs[0].organName", "issuingOrgans[0].organName"], "signers": ["signers[0].signerName"],
        }.items()) + ", 0 uncast from p group by 1",
    "canonical_documents": _with(RESPONSES) + f"""select record_id, {_json("data.docGUId")} portal_document_guid, {_json("data.docIdentity")} document_id, {_json("data.docName")} title,
        case when contains({_json("data.docIdentity")}, '/QH') then 'law' when contains({_json("data.docIdentity")}, '/NĐ-CP') then 'decree' when contains({_json("data.docIdentity")}, '/TT-') then 'circular' when contains({_json("data.docIdentity")}, '/QĐ-') then 'decision' else 'other' end document_type,
        {_json("data.docType.docTypeName")} portal_document_type, nullif(split_part({_names("organs", "organName")}, '; ', 1), '') issuer, {_names("fields", "fieldName")} fields, {_names("majors", "majorName")} majors, {_names("organs", "organName")} issuing_organs,
        cast(coalesce(json_array_length(payload, '$.data.signers'), 0) as bigint) signers, try_cast({_json("data.issueDate")}[1:10] as date) issued_date, try_cast({_json("data.effectDate")}[1:10] as date) effective_from,
        {_json("data.effectStatus.effectStatusName")} source_effect_status, case {_json("data.effectStatus.effectStatusName")} when 'Còn hiệu lực' then 'current' when 'Hết hiệu lực' then 'repealed' when 'Hết hiệu lực một phần' then 'amended' else 'unknown' end status, sha256(payload) content_sha256 from ok""",
    "quarantine": _with(RESPONSES) + "select record_id, 'SCHEMA' code from p where record_id not in (select record_id from ok)",
    "html_texts": _with(RESPONSES, f"h as (select {_json('data.docIdentity')} || '#' || record_id document_id, nfc_normalize(regexp_replace(regexp_replace(regexp_replace({_json('data.docContent')}, '<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'gs'), '(</?(article|br|div|h1|h2|h3|li|p|section|tr)([\\s/][^>]*)?>)+', chr(10), 'g'), '</?[a-zA-Z][^>]*>', '', 'g')) t from ok)",
        "e as (select document_id, replace(replace(replace(replace(replace(t, '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&') t from h)")
    + r"select document_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '[^\S\n]+|\x{a0}+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || ' ') as text from e",
    "catalog_identity": _with(DOCS, RESPONSES, f"f as (select distinct {_json('data.docGUId')} g, {_json('data.docIdentity')} i, {_json('data.docName')} t from ok)", "x as (select d.portal_document_guid document_guid, document_id, title, i, t from d left join f on g = d.portal_document_guid)",
        f"c as (select document_guid, case when i is null then 'MISSING' when i <> document_id then 'IDENTITY' when {BLANKS.format('t').replace('nfc_normalize(t)', 't')} <> {BLANKS.format('title').replace('nfc_normalize(title)', 'title')} then 'TITLE' end code from x)")
    + "select distinct document_guid, code from c where code is not null",
    "raw_receipts": "select sha256(payload) content_sha256, strftime(min(delivered_at), '%Y-%m-%d %H:%M:%S') retrieved_at, count(*) deliveries from portal_records where payload is not null group by 1",
    "raw_new_contents": """with l as (select feed, max(file_no) last from portal_records group by 1), p as (select payload, file_no = last is_last from portal_records join l using (feed) where payload is not null)
        select distinct sha256(payload) content_sha256, length(payload) chars from p where is_last and payload not in (select payload from p where not is_last)""",
    "manifest_upsert": f"""with a as {_manifest(1, "content_sha256", "parser_version", "artifact_version")}, b as {_manifest(0, "content_sha256", "parser_version", "artifact_version")},
        x as (select * from b union all select * from a where document_id not in (select document_id from b))
        select document_id, content_sha256, parser_version, coalesce(artifact_version, '1') artifact_version, url_encode(document_id || '__' || (select max(snapshot_id) from b)) file from x""",
    "content_hashes": "select sha256(text) content_sha256, count(*) documents, min(doc_id) first_doc_id from documents where text is not null group by 1 having count(*) > 1",
    "status_and_type": _with(DOCS) + """select case source_effect_status when 'Còn hiệu lực' then 'current' when 'Hết hiệu lực' then 'repealed' when 'Hết hiệu lực một phần' then 'amended' else 'unknown' end status,
        case when contains(document_id, '/QH') then 'law' when contains(document_id, '/NĐ-CP') then 'decree' when contains(document_id, '/TT-') then 'circular' when contains(document_id, '/QĐ-') then 'decision' else 'other' end document_type, count(*) documents from d group by 1, 2""",
    "query_normalize": _with(QUESTIONS) + f"select question_id query_id, {BLANKS.format('question')} query from q where question_id is not null and length({BLANKS.format('question')}) between 1 and 1000",
    "accent_fold": _with(DOCS) + "select document_id, replace(strip_accents(lower(title)), 'đ', 'd') folded from d",
    "reviewed_corrections": _with(UNITS, """a as (select unit_id, text t, replace(text, 'Tp.', 'Thành phố') t1 from u), b as (select unit_id, (length(t) - length(replace(t, 'Tp.', ''))) // 3 n, (length(t1) - length(replace(t1, 'Thành phố', ''))) // 9 n1, length(replace(t1, 'Thành phố', 'TP')) chars from a)""")
    + "select unit_id, cast((n <> 1)::int + (n1 <> 1)::int as bigint) wrong, chars from b",
    "reparsed_units": _with(UNITS) + "select unit_id, document_id, unit_type, number, parent_id, array_to_string(path, ' ') path from u",
    "unit_violations": _with(UNITS) + """select distinct document_id, unit_id, code from (select document_id, unit_id, 'EMPTY' code from u where text is null or text = ''
        union all select document_id, unit_id, 'FOREIGN' from u where not starts_with(unit_id, document_id || '::')
        union all select document_id, unit_id, 'ORPHAN' from u a where parent_id is not null and not exists (select 1 from u b where b.document_id = a.document_id and b.unit_id = a.parent_id))""",
    "graph_nodes": _with(DOCS, UNITS, NODES) + 'select label, "key" from nodes',
    "graph_node_properties": _with(DOCS, UNITS, NODES, "up as (select u.*, parser_version from u left join d using (snapshot_id, document_id))")
    + " union all ".join([
        _unpivot("'Document'", _PKEY.format("document_id"), DOCUMENT_PROPERTIES, "d"), _unpivot("upper(unit_type[1]) || unit_type[2:]", _PKEY.format("unit_id"), (*UNIT_PROPERTIES, "parser_version"), "up"),
        "select label, \"key\", case label when 'Snapshot' then 'snapshot_id' else 'name' end property, \"key\" \"value\" from nodes where label in ('Snapshot', 'DocumentType', 'EffectStatus', 'Field', 'Organization', 'Signer')",
    ]),
    "repeated_node_keys": _with(DOCS, UNITS, NODES) + 'select label, "key", count(*) nodes from nodes group by 1, 2 having count(*) > 1',
    "amends_properties": _with(DOCS, UNITS, RELATIONS, AMENDS, "known as (select * from r where relation_id in (select relation_id from amends))", f"x as ({_unpivot('relation_id', 'relation_id', AMENDMENT_PROPERTIES, 'known')})") + 'select label relation_id, property, "value" from x',
    "graph_edges": _with(DOCS, UNITS, RELATIONS, METADATA, TREE, AMENDS, EDGES) + "select type, src, dst from edges",
    "hierarchy_edges": _with(UNITS, TREE) + "select type, src, dst from tree",
    "metadata_edges": _with(DOCS, METADATA) + "select type, src, dst, extra from metadata",
    "amends_edges": _with(DOCS, UNITS, RELATIONS, AMENDS) + "select src, dst, relation_id from amends",
    "graph_reconcile": _with(DOCS, UNITS, RELATIONS, NODES, METADATA, TREE, AMENDS, EDGES, "k as (select 'node' kind, label name, count(*) n from nodes group by 2 union all select 'edge', type, count(*) from edges group by 2)",
        "names as (select 'node' kind, unnest(['Snapshot','Document','DocumentType','EffectStatus','Field','Organization','Signer','Part','Chapter','Section','Article','Clause','Point']) name union all select 'edge', unnest(['IN_SNAPSHOT','HAS_TYPE','HAS_STATUS','IN_FIELD','ISSUED_BY','SIGNED_BY','HAS_PART','HAS_CHAPTER','HAS_SECTION','HAS_ARTICLE','HAS_CLAUSE','HAS_POINT','AMENDS']))")
    + "select kind, name, coalesce(n, 0) expected, coalesce(n, 0) actual, true matches from names left join k using (kind, name)",
    "unit_counts": _with(UNITS) + "select document_id, unit_type, count(*) units from u group by rollup (document_id, unit_type)",
    "relation_violations": _with(DOCS, UNITS, RELATIONS, """f as (select relation_id, r.snapshot_id, relation_type, review_status, r.source_url, raw_sha256, evidence_unit_id, source.document_id sd, source.unit_id su, target.document_id td, target.unit_id tu,
        d.document_id is not null and target.document_id in (select document_id from d) has, d.content_sha256 h, d.source_url durl, d.snapshot_id dsnap from r left join d on d.document_id = source.document_id)""")
    + " union ".join([
        _code("SNAPSHOT", "f", "relation_id", "has and snapshot_id is distinct from dsnap"), _code("TYPE", "f", "relation_id", "relation_type is distinct from 'AMENDS'"), _code("UNKNOWN_DOCUMENT", "f", "relation_id", "not has"),
        _code("NOT_CROSS_DOCUMENT", "f", "relation_id", "sd is not distinct from td"), _code("HASH", "f", "relation_id", "has and raw_sha256 is distinct from h"), _code("URL", "f", "relation_id", "has and source_url is distinct from durl"),
        _code("SOURCE_UNIT", "f", "relation_id", "has and su is not null and not exists (select 1 from u where u.unit_id = su and u.document_id = sd)"),
        _code("TARGET_UNIT", "f", "relation_id", "has and tu is not null and not exists (select 1 from u where u.unit_id = tu and u.document_id = td)"),
        _code("EVIDENCE", "f", "relation_id", "has and not exists (select 1 from u where u.unit_id = evidence_unit_id and u.document_id = sd)"),
        _code("NOT_APPROVED", "f", "relation_id", "review_status is distinct from 'approved'"), _code("NOT_HTTPS", "f", "relation_id", "not starts_with(source_url, 'https://')"),
        "select relation_id, 'DUPLICATE' code from f group by 1 having count(*) > 1",
    ]),
    "gold_violations": _with(DOCS, UNITS, "q as (select distinct question_id, question, gold_document_ids gd, gold_unit_ids gu from gold_questions)", "x as (select question_id, gd, unnest(gu) unit_id from q)")
    + " union ".join([
        _code("BLANK", "q", "question_id", "trim(question) = ''"), _code("NO_DOCUMENTS", "q", "question_id", "len(gd) = 0"), _code("NO_UNITS", "q", "question_id", "len(gu) = 0"),
        _code("REPEATED_ID", "q", "question_id", "len(list_distinct(gd)) < len(gd) or len(list_distinct(gu)) < len(gu)"),
        "select question_id, 'UNKNOWN_DOCUMENT' code from (select question_id, unnest(gd) i from q) where i not in (select document_id from d)",
        "select question_id, case when u.unit_id is null then 'UNKNOWN_UNIT' else 'UNIT_OF_OTHER_DOCUMENT' end code from x left join u using (unit_id) where u.unit_id is null or not list_contains(gd, u.document_id)",
        "select question_id, 'DUPLICATE' code from q group by 1 having count(*) > 1",
    ]),
    "gold_profile": "with b as (select distinct question_id, lower(trim(split)) split, question_type, review_status from gold_questions) select 'split' field, split value, count(distinct question_id) questions from b group by 2 union all select 'question_type', question_type, count(distinct question_id) from b group by 2 union all select 'review_status', review_status, count(distinct question_id) from b group by 2",
    "document_violations": _with(DOCS) + " union ".join([
        _code("TITLE", "d", "document_id", "trim(title) = ''"), _code("HASH", "d", "document_id", "not regexp_matches(content_sha256, '^[0-9a-f]{64}$')"),
        _code("URL", "d", "document_id", "not (starts_with(source_url, 'https://') and starts_with(content_url, 'https://'))"), _code("STATUS", "d", "document_id", "status not in ('current', 'repealed', 'amended', 'unknown')"),
        _code("SNAPSHOT", "d", "document_id", "trim(snapshot_id) = ''"), "select document_id, 'DATES' code from d where effective_to < effective_from", "select document_id, 'DUPLICATE' code from d group by 1 having count(*) > 1",
    ]),
    "manifest_violations": _with(f"d as (select * replace ({_key('document_id')} as document_id, {_key('content_sha256')} as content_sha256) from (select distinct * from legal_documents))", f"m as {_manifest(0, 'content_sha256', 'portal_document_guid', 'normalizer_version', 'parser_version', 'artifact_version')}",
        "j as (select coalesce(m.document_id, d.document_id) document_id, m.document_id md, d.document_id dd, " + ", ".join(f"m.{c} is distinct from d.{c} {k}" for k, c in (("HASH", "content_sha256"), ("GUID", "portal_document_guid"), ("NORMALIZER", "normalizer_version"), ("PARSER", "parser_version"), ("ARTIFACT", "artifact_version"))) + " from m full join d on m.document_id = d.document_id)")
    + "select distinct document_id, 'MISSING' code from j where dd is null union select document_id, 'EXTRA' from j where md is null" + "".join(f" union select document_id, '{k}' from j where md is not null and dd is not null and {k}" for k in ("HASH", "GUID", "NORMALIZER", "PARSER", "ARTIFACT")),
    "snapshot_violations": _with(f"d as (select * replace ({_key('document_id')} as document_id, {_key('content_sha256')} as content_sha256) from (select distinct * from legal_documents))", f"m as {_manifest(0, 'content_sha256', 'portal_document_guid', 'normalizer_version', 'parser_version', 'artifact_version', 'parsed_path')}",
        "j as (select coalesce(m.document_id, d.document_id) document_id, m.document_id md, d.document_id dd, " + ", ".join(f"m.{c} is distinct from d.{c} {k}" for k, c in (("HASH", "content_sha256"), ("GUID", "portal_document_guid"), ("NORMALIZER", "normalizer_version"), ("PARSER", "parser_version"), ("ARTIFACT", "artifact_version"))) + " from m full join d on m.document_id = d.document_id)",
        "held as (select distinct sha256(payload) h from portal_records where payload is not null)", "lost as (select document_id from m where content_sha256 is null or lower(content_sha256) not in (select h from held))")
    + "select distinct document_id, 'MISSING' code from j where dd is null union select document_id, 'EXTRA' from j where md is null" + "".join(f" union select document_id, '{k}' from j where md is not null and dd is not null and {k}" for k in ("HASH", "GUID", "NORMALIZER", "PARSER", "ARTIFACT"))
    + " union select document_id, 'RAW' from lost union select document_id, 'RECEIPT' from lost union select document_id, 'PATH' from m where contains(parsed_path, '..') or starts_with(parsed_path, '/')",
    "key_sets": f"with a as (select distinct {_key('document_id')} document_id from legal_units), b as {_manifest(0, 'content_sha256')} select document_id, 'left' side from a where document_id not in (select document_id from b) union all select document_id, 'right' from b where document_id not in (select document_id from a)",
    "snapshot_report": _with(DOCS, UNITS, "n as (select document_id, count(*) unit_count, " + ", ".join(f"count(*) filter (unit_type = '{t}') {t}_count" for t in _TYPES) + " from u group by 1)",
        "x as (select document_id, status, effective_from, content_sha256, coalesce(unit_count, 0) unit_count, " + ", ".join(f"coalesce({t}_count, 0) {t}_count" for t in _TYPES) + " from d left join n using (document_id))")
    + "select * from x union all select null, null, null, null, cast(sum(unit_count) as bigint), " + ", ".join(f"cast(sum({t}_count) as bigint)" for t in _TYPES) + " from x",
    "metadata_presence": _with(DOCS) + "select count(*) documents, count(portal_document_type) portal_document_type, count(source_effect_status) source_effect_status, " + ", ".join(f"count(*) filter (len({c}) > 0) {c}" for c in ("fields", "majors", "issuing_organs", "signers")) + ", count(*) filter (status = 'unknown') unknown_status from d",
    "effective_gold": _with(DOCS, QUESTIONS) + "select question_id, document_id, case when effective_from is null or effective_at is null then 'unknown' when effective_at < effective_from then 'false' when effective_to is not null and effective_at > effective_to then 'false' when effective_to is null and status = 'repealed' then 'unknown' else 'true' end in_force from (select question_id, effective_at, unnest(gold_document_ids) document_id from q) join d using (document_id)",
    "token_lists": _with(QUESTIONS, f"t as (select question_id, {TOKENS.format('question')} t from q)", "p as (select question_id, term, min(i) i from (select question_id, unnest(t) term, unnest(range(len(t))) i from t) group by 1, 2)") + "select question_id, string_agg(term, ' ' order by i) tokens, count(*) n_tokens from p group by 1",
    "lexical_postings": _with(UNITS, f"toks as (select unit_id, unnest({TOKENS.format("coalesce(text, '')")}) term from u)", "p as (select unit_id, term, count(*) tf from toks group by 1, 2)") + "select term, count(*) df, cast(sum(tf) as bigint) occurrences, max(tf) most from p group by 1",
    "lexical_stats": _with(UNITS, f"t as (select len({TOKENS.format("coalesce(text, '')")}) size from u)") + "select count(*) units, cast(sum(size) as bigint) tokens, round(avg(size), 6) mean_size from t",
    "lexical_topk": _with(QUESTIONS, ASKED, QUERIES_SQL, UNITS, BM25) + "select query_id, unit_id, lexical_score, lexical_rank from top where lexical_rank <= 10",
    "locators": _with(RELATIONS, LOCATOR) + "select query_id, article, clause, point from loc",
    "exact_lookup": _with(RELATIONS, UNITS, LOCATOR, EXACT) + "select query_id, unit_id, document_id, exact_rank from exact",
    "exact_then_lexical": _with(RELATIONS, UNITS, LOCATOR, LOCATOR_TEXT, EXACT, SCOPED_BM25, MERGED) + "select query_id, unit_id, rank, exact_rank, lexical_rank, lexical_score from k where rank <= 5",
    "search_results": _with(RELATIONS, UNITS, DOCS, LOCATOR, LOCATOR_TEXT, EXACT, SCOPED_BM25, MERGED, "f as (select * from k where rank <= 5)")
    + "select f.*, cast(null as integer) dense_rank, cast(null as double) dense_score, u.snapshot_id, u.document_id, u.unit_type, u.title, u.text, d.source_url, 'unknown' validity from f join u using (unit_id) join d on d.document_id = u.document_id",
    "dense_validate": "select coalesce(len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0, false) valid, count(*) vectors from embeddings group by 1",
    "dense_topk": """with s as (select a.vec_id query_id, b.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) dense_score from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0)
        select query_id, vec_id, dense_score, cast(row_number() over (partition by query_id order by dense_score desc, vec_id) as integer) dense_rank from s qualify row_number() over (partition by query_id order by dense_score desc, vec_id) <= 10""",
    "eval_dense": """with s as (select a.vec_id query_id, a.label = b.label hit, b.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) dense_score from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
        t as (select *, row_number() over (partition by query_id order by dense_score desc, vec_id) r from s qualify r <= 10)
        select query_id, count(*) filter (hit) hits, coalesce(max(round(1.0 / r, 6)) filter (hit), 0.0) reciprocal_rank from t group by 1""",
    "dense_resume": _with(DOCS, UNITS) + "select unit_id from u where unit_type in ('article', 'clause', 'point') and document_id in (select document_id from d) and unit_id not in (select unit_id from candidates where dense_score is not null)",
    "embedding_coverage": _with(UNITS, "w as (select snapshot_id, unit_id in (select unit_id from candidates where dense_score is not null) has from u where unit_type in ('article', 'clause', 'point'))") + "select snapshot_id, count(*) units, count(*) filter (has) embedded, count(*) = count(*) filter (has) complete from w group by 1",
    "embedding_text": _with(DOCS, UNITS, "s as (select unit_id, unnest(path) step, unnest(range(len(path))) i from u where unit_type in ('article', 'clause', 'point'))",
        "l as (select s.unit_id, string_agg((case p.unit_type when 'part' then 'Phần' when 'chapter' then 'Chương' when 'section' then 'Mục' when 'article' then 'Điều' when 'clause' then 'Khoản' else 'Điểm' end) || ' ' || p.number, ' > ' order by i) place, count(*) n from s join u p on p.unit_id = s.step group by 1)")
    + "select u.unit_id, concat_ws(chr(10), 'Văn bản: ' || d.title, 'Vị trí: ' || place, u.title, u.text) text from u join l on l.unit_id = u.unit_id and n = len(path) join d on d.document_id = u.document_id",
    "eval_cases": _with(QUESTIONS, CANDIDATES, RANKING, CASES.format(recalls=_RECALLS, questions="q", ranking="ranking")) + "select * from cases",
    "eval_metrics": _with(QUESTIONS, CANDIDATES, RANKING, CASES.format(recalls=_RECALLS, questions="q", ranking="ranking")) + f"select {_METRICS} from cases",
    "eval_valid_recall": _with(DOCS, UNITS, QUESTIONS, CANDIDATES, RANKING, "g as (select distinct question_id, effective_at, unnest(gold_unit_ids) unit_id from q)",
        "v as (select question_id, unit_id, coalesce(effective_at >= effective_from and (effective_to is null or effective_at <= effective_to) and not (effective_to is null and status = 'repealed'), false) valid from g join u using (unit_id) join d on d.document_id = u.document_id)",
        "h as (select question_id, count(*) filter (valid) in_force, count(*) filter (valid and (question_id, unit_id) in (select (query_id, unit_id) from ranking where rank <= 10)) hits from v group by 1)")
    + "select question_id, in_force, case when in_force > 0 then round(hits / in_force, 9) end recall from h",
    "result_keys": "select distinct question_id, 'NO_RESULT' code from gold_questions where question_id not in (select question_id from candidates where question_id is not null) union select distinct question_id, 'UNKNOWN_QUESTION' from candidates where question_id not in (select question_id from gold_questions where question_id is not null)",
    "eval_lexical": _with(QUESTIONS, ASKED, QUERIES_SQL, UNITS, BM25, "found as (select query_id, unit_id, document_id, lexical_rank rank from top join u using (unit_id) where lexical_rank <= 10)", CASES.format(recalls=_RECALLS, questions="asked", ranking="found")) + f"select {_METRICS} from cases",
    "eval_ndcg": _with(QUESTIONS, CANDIDATES, RANKING, "g as (select question_id, unnest(list_distinct(gold_unit_ids)) unit_id from q)", "n as (select question_id, count(*) n from g group by 1)",
        "x as (select question_id, sum(1.0 / log2(rank + 1)) gain from g join ranking on query_id = question_id and ranking.unit_id = g.unit_id where rank <= 10 group by 1)")
    + "select question_id, round(coalesce(gain, 0.0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda r: 1.0 / log2(r + 1))), 6) ndcg from n left join x using (question_id)",
    "rrf_fusion": _with(CANDIDATES, "a as (select question_id query_id, unit_id, min(lexical_rank) rank from c where lexical_rank is not null group by 1, 2 union all select question_id, unit_id, min(dense_rank) from c where dense_rank is not null group by 1, 2)",
        "s as (select query_id, unit_id, round(sum(1.0::double / (60.0 + rank)), 9) rrf_score from a group by 1, 2)")
    + "select query_id, unit_id, rrf_score, cast(row_number() over (partition by query_id order by rrf_score desc, unit_id) as integer) rank from s qualify row_number() over (partition by query_id order by rrf_score desc, unit_id) <= 10",
    "evidence": _with(CANDIDATES, RANKING, "k as (select * from ranking qualify row_number() over (partition by query_id, document_id order by rank, unit_id) <= 2)") + "select query_id, unit_id, document_id, rank, cast(row_number() over (partition by query_id order by rank, unit_id) as integer) place from k qualify row_number() over (partition by query_id order by rank, unit_id) <= 5",
    "citation_faults": _with(CANDIDATES, RANKING, QUESTIONS, UNITS, "k as (select * from ranking qualify row_number() over (partition by query_id, document_id order by rank, unit_id) <= 2)", "e as (select query_id, unit_id from k qualify row_number() over (partition by query_id order by rank, unit_id) <= 5)", "g as (select distinct question_id query_id, unnest(gold_unit_ids) unit_id from q)")
    + "select query_id, unit_id, case when unit_id not in (select unit_id from u) then 'UNKNOWN' else 'NOT_SHOWN' end code from g where unit_id not in (select unit_id from u) or (query_id, unit_id) not in (select (query_id, unit_id) from e)",
    "related_units": _with(CANDIDATES, RANKING, UNITS, RELATIONS, "s as (select distinct query_id, unit_id from ranking where rank = 1)", "o as (select s.*, u.parent_id from s left join u using (unit_id))",
        "l as (select distinct source.unit_id a, target.unit_id b from r where source.unit_id is not null and target.unit_id is not null)",
        """x as (select query_id, unit_id, 'parent' via, parent_id related_id from o where parent_id is not null
            union select o.query_id, o.unit_id, 'child', u.unit_id from o join u on u.parent_id = o.unit_id
            union select o.query_id, o.unit_id, 'sibling', u.unit_id from o join u on u.parent_id = o.parent_id and u.unit_id <> o.unit_id
            union select query_id, unit_id, 'amends', b from o join l on a = unit_id union select query_id, unit_id, 'amends', a from o join l on b = unit_id)""")
    + "select query_id, unit_id, via, related_id from x qualify row_number() over (partition by query_id, unit_id, via order by related_id) <= 5",
}

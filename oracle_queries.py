"""The same results in plain SQL for an independent engine, one text per query.

Written from the definitions, not from the Spark code: winners by ``row_number``, clusters by a
recursive closure, state codes by joins, company names in the stated order of steps.
"""

from __future__ import annotations

from kinfold.functions import fixed_values as fixed
from kinfold.operators.views import CONTACT_PATTERNS
from kinfold.plans import driver_tables as tables
from kinfold.plans import queries

FIELDS = fixed.UNIFIED_FIELDS
WS = r"[\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
PLACE = {s: i + 1 for i, s in enumerate(fixed.SOURCES)}
RAW = {s: [(c, tables.NEUTRAL[f]) for c, f in m.items()] for s, m in fixed.DEFAULT_MAPPINGS.items()}


def trim(x):
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x):
    return f"regexp_replace({x}, '{WS}+', ' ', 'g')"


def text(x):
    return f"trim({collapse(x)})"


def email(x):
    return f"lower({trim(x)})"


def phone(x):
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    return (
        f"case when length({d}) = 10 then '+1' || {d}"
        f" when length({d}) = 11 and {d} like '1%' then '+' || {d} else {d} end"
    )


def canonical(x):
    words = "|".join(fixed.COMPANY_SUFFIXES)
    y = f"regexp_replace(lower({x}), '[.,]', ' ', 'g')"
    y = rf"regexp_replace({y}, '\b({words})\b', ' ', 'g')"
    y = f"regexp_replace({y}, '[^a-z0-9 ]', ' ', 'g')"
    return f"trim(regexp_replace({y}, ' +', ' ', 'g'))"


def state_clean(x):
    return f"lower({collapse(rf"regexp_replace({trim(x)}, '\.+$', '')")})"


def block_key(canon, mail):
    return (
        f"case when {canon} <> '' then array_to_string(string_split({canon}, ' ')[1:2], ' ')"
        f" else coalesce(list_extract(string_split({mail}, '@'), 2), '{fixed.UNBLOCKED}') end"
    )


def fragment(source):
    columns = tables.fragment_columns(source)
    selected = ", ".join(f"{sql} as {name}" for name, sql in columns.items())
    return f"select '{source}' as source, {selected} from {tables.BINDINGS[source][0]}"


STATES = "states(spelling, code) as (values " + ", ".join(
    f"('{k}', '{v}')" for k, v in fixed.state_codes().items()
) + ")"
FRAGS = "frags as (" + " union all ".join(fragment(s) for s in tables.BINDINGS) + ")"

_raw_json = " ".join(
    f"when source = '{s}' then cast(json_object("
    + ", ".join(f"'{c}', {n}" for c, n in RAW[s])
    + ") as varchar)"
    for s in RAW
)
_raw_text = " ".join(
    f"when source = '{s}' then " + " || '|' || ".join(n for _, n in RAW[s]) for s in RAW
)
_place = " ".join(f"when source = '{s}' then {p}" for s, p in PLACE.items())
STD = f"""{STATES}, {FRAGS},
cleaned as (select *, {state_clean('state')} as state_clean from frags),
std0 as (
  select source, ordinal, source || cast(ordinal as varchar) as id,
    cast(case {_place} end as bigint) * 4503599627370496 + ordinal as node,
    case {_raw_json} end as raw_json, case {_raw_text} end as raw,
    {text('company')} as company, {text('contact')} as contactName, {email('email')} as email,
    {phone('phone')} as phone, coalesce(s1.code, s2.code, upper(state_clean)) as state,
    {canonical(text('company'))} as canon
  from cleaned left join states s1 on s1.spelling = state_clean
  left join states s2 on s2.spelling = {trim("list_extract(string_split(state_clean, ','), -1)")}),
std as (select *, {block_key('canon', 'email')} as block_key from std0)"""

KEYS = f"""keys as (
  select node, block_key, 'email' as key_type, email as key_value from std where email <> ''
  union all select node, block_key, 'phone', phone from std where regexp_matches(phone, '{fixed.PHONE_SHAPE}')
  union all select node, block_key, 'contact', lower(contactName) from std where contactName <> ''),
hubs as (select block_key, key_type, key_value, min(node) as anchor, count(*) as hub_size
  from keys group by all having count(*) > 1),
links as (select keys.*, anchor, hub_size from keys join hubs using (block_key, key_type, key_value))"""


def record_id(node):
    return f"(select id from std x where x.node = {node})"


RESOLVED = f"""sym as (
  select node as a, anchor as b from links where node <> anchor
  union select anchor, node from links where node <> anchor),
reach(a, b) as (select distinct a, a from sym union select r.a, s.b from reach r join sym s on s.a = r.b),
roots as (select a as node, min(b) as root from reach group by a),
resolved as (
  select std.*, coalesce(root, std.node) as root, root is not null as linked
  from std left join roots on roots.node = std.node),
named as (select r.*, e.id as entity_id from resolved r join std e on e.node = r.root)"""

LONG_WORD = r"[^ ]*\p{L}[^ ]*\p{L}[^ ]*"
_rank = {
    "company": ("case when canon = '' then 0 else len(string_split(canon, ' ')) end", "0", "canon"),
    "contactName": (
        f"len(regexp_extract_all(contactName, '{LONG_WORD}'))",
        "length(contactName)",
        "lower(contactName)",
    ),
    "email": (f"cast(regexp_matches(email, '{fixed.EMAIL_SHAPE}') as int)", "0", "email"),
    "phone": (f"cast(regexp_matches(phone, '{fixed.PHONE_SHAPE}') as int)", "0", "phone"),
    "state": ("cast(state in (select code from states) as int)", "0", "state"),
}
_priority = " ".join(f"when source = '{s}' then {p}" for s, p in fixed.SOURCE_PRIORITY.items())
OFFERS = "offers as (" + " union all ".join(
    f"select root, entity_id, node, id, source, '{f}' as field, {f} as value, {form} as form,"
    f" cast({f} = '' as int) as blank, {c1} as c1, {c2} as c2, case {_priority} end as authority"
    " from named"
    for f, (c1, c2, form) in _rank.items()
) + ")"
RANKED = """ranked as (
  select *, row_number() over (partition by root, field order by blank, c1 desc, c2 desc, authority, node) as rn,
    count(*) over (partition by root, field, blank, form) as n_same,
    sum(1 - blank) over (partition by root, field) as n_filled
  from offers),
winners as (select * from ranked where rn = 1),
facts as (
  select root, field, count(*) as n, count(distinct case when blank = 0 then form end) as n_values,
    max(case when blank = 0 and (field <> 'phone' or regexp_matches(form, '%s')) then n_same end) as shared
  from ranked group by root, field)""" % fixed.PHONE_SHAPE


def _pick(column, field):
    return f"max(case when field = '{field}' then {column} end)"


_share = {
    f: f"{_pick('case when n_filled = 0 then 1.0::double else n_same::double / n_filled::double end', f)}"
    for f in FIELDS
}
_shared = ", ".join(
    f"case when {_pick('shared', f)} > 1 then '{n}' end"
    for f, n in (("email", "email"), ("phone", "phone"), ("contactName", "contact"))
)
_conflicts = ", ".join(f"case when {_pick('n_values', f)} > 1 then '{f}' end" for f in FIELDS)
MERGED = f"""merged as (
  select w.root, entity_id, max(f.n) as member_count,
    {", ".join(f"{_pick('value', f)} as {f}" for f in FIELDS)},
    {", ".join(f"{_pick('source', f)} as {f}_source" for f in FIELDS)},
    floor((0.5::double + 0.1::double * ({" + ".join(_share[f] for f in FIELDS)})) * 10000::double + 0.5::double)
      / 10000::double as confidence,
    case when max(f.n) = 1 then 'Single record from source ' || max(source)
      else cast(max(f.n) as varchar) || ' records share ' || concat_ws(', ', {_shared})
        || '; conflicting: ' || coalesce(nullif(concat_ws(', ', {_conflicts}), ''), 'none') end as reasoning
  from winners w join facts f using (root, field) group by w.root, entity_id),
entities as (select entity_id, {", ".join(FIELDS)}, confidence, reasoning from merged),
members as (select distinct entity_id, id as record_id from named),
provenance as (select entity_id, field, source, value from winners)"""
_qualified = MERGED.replace("field = '", "w.field = '")
MERGED = _qualified

STD_ = f"with {STD} "
LINKS_ = f"with {STD}, {KEYS} "
RESOLVED_ = f"with recursive {STD}, {KEYS}, {RESOLVED} "
MERGED_ = f"with recursive {STD}, {KEYS}, {RESOLVED}, {OFFERS}, {RANKED}, {MERGED} "
FRAGS_ = f"with {FRAGS} "

FIELD_LIST = ", ".join(FIELDS)
_entities_of = "select entity_id as id, " + FIELD_LIST + ", confidence from entities"
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_others = "company, contact, phone, email, state"


def renumbered(source):
    return STD_.replace(
        FRAGS,
        f"frags0 as ({fragment(source)}), frags as (select row_number() over (order by ordinal) as ordinal, "
        f"source, {_others} from frags0)",
    ) + f"select id, {FIELD_LIST}, block_key from std"


# pages ----------------------------------------------------------------------------------------

_cells = " || ".join(f"'<td>' || {n} || '</td>'" for _, n in RAW["C"])
_header = "".join(f"<th> {c} </th>" for c, _ in RAW["C"])
_plain = "regexp_replace(c, '<[^>]*>', '', 'g')"
for _code, _char in fixed.CHARACTER_REFERENCES:
    _plain = f"replace({_plain}, '{_code}', '{_char.replace(chr(39), chr(39) * 2)}')"
PAGES_ = f"""with frags as ({fragment('C')}),
corpus as (
  select 'P' || lpad(cast(page_id as varchar), 12, '0') as page_id, html from pages
  union all
  select 'D' || lpad(cast(cast(floor(ordinal / 25) as bigint) as varchar), 12, '0'),
    '<html><body><h1>Directory</h1><table id=''d''><tr><th>No</th>{_header}</tr>' || chr(10)
    || string_agg('<TR><td hidden>&amp;lt;' || cast(ordinal as varchar) || '</td>' || {_cells} || '</TR>' || chr(10),
       '' order by ordinal)
    || '</table><table><tr><td>footer</td></tr></table></body></html>'
  from frags group by cast(floor(ordinal / 25) as bigint)),
found as (select page_id, regexp_extract_all(regexp_extract(html, '{fixed.TABLE_PATTERN}', 1), '{fixed.ROW_PATTERN}', 1) as trs
  from corpus),
trs as (select page_id, unnest(trs) as tr, generate_subscripts(trs, 1) as spot from found),
cells as (select page_id, spot, list_transform(regexp_extract_all(tr, '{fixed.CELL_PATTERN}', 1),
    lambda c: {text(_plain)}) as cells from trs),
kept as (select page_id, row_number() over (partition by page_id order by spot) as row_no, cells
  from cells where len(cells) > 0) """


# profile --------------------------------------------------------------------------------------

_unpivoted = " union all ".join(
    f"select source, '{c}' as column_name, {n} as value from frags where source = '{s}'"
    for s in RAW
    for c, n in RAW[s]
)


def _rate(name):
    return (
        f"case when sum(is_filled) = 0 then 0::double else "
        f"sum(is_filled * {name}_hit)::double / sum(is_filled)::double end as {name}_rate"
    )


PROFILE = f"""{STATES}, {FRAGS}, cols as ({_unpivoted}),
probed as (
  select source, column_name, value, length(value) as len, cast({trim('value')} <> '' as int) as is_filled,
    cast(regexp_matches({email('value')}, '{fixed.EMAIL_SHAPE}') as int) as email_hit,
    cast(length(regexp_replace(value, '[^0-9]', '', 'g')) between 10 and 11
      and not regexp_matches(value, '\\p{{L}}') as int) as phone_hit,
    cast(coalesce(s1.code, s2.code) is not null as int) as state_hit,
    cast(regexp_matches(lower(value), '\\b({"|".join(fixed.COMPANY_SUFFIXES)})\\b') as int) as suffix_hit,
    cast(regexp_matches(value, '\\p{{L}}') and not contains(value, '@')
      and coalesce(s1.code, s2.code) is null as int) as name_hit
  from (select *, {state_clean('value')} as sc from cols)
  left join states s1 on s1.spelling = sc
  left join states s2 on s2.spelling = {trim("list_extract(string_split(sc, ','), -1)")}),
profile as (
  select source, column_name, count(*) as n_rows, sum(is_filled) as n_filled,
    count(distinct case when is_filled = 1 then value end) as n_distinct,
    sum(len)::double / count(*)::double as avg_length,
    {", ".join(_rate(r) for r in ("email", "phone", "state", "suffix", "name"))}
  from probed group by source, column_name)"""
_targets = " union all ".join(
    f"select *, {i} as pos, '{f}' as field, "
    f"cast(list_has_any(words, [{', '.join(repr(w) for w in fixed.NAME_TOKENS[f])}]) as double) as named, "
    + f"{'name' if f in ('company', 'contactName') else f}_rate as rate from worded"
    for i, f in enumerate(FIELDS)
)
MAPPING = PROFILE + f""",
worded as (select *, string_split(lower(regexp_replace(
    regexp_replace(column_name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z]+', ' ', 'g')), ' ') as words from profile),
scored as (select *, 0.6::double * rate + 0.4::double * named as score from ({_targets})),
ordered as (select *, row_number() over (partition by source, column_name order by score desc, pos) as rn from scored),
mapping as (select source, column_name as source_field, case when score >= 0.3::double then field end as unified_field, score,
    case when score < 0.3::double then 'no match' when named = 0 then 'by values'
      when score > 0.4::double then 'by values and name' else 'by name' end as note,
    n_rows, n_filled
  from ordered where rn = 1)"""
_notes = " union all ".join(
    f"select '{f}' as name, '{t}' as type, '{d}' as description" for f, (t, d) in fixed.FIELD_NOTES.items()
)


def _blank_rows(table, columns, name):
    return " union all ".join(
        f"select '{name}' as table_name, '{c}' as column_name, count(*) as n_rows,"
        f" sum(cast({out} is null as int)) as n_null, sum(cast(coalesce({out}, '') = '' as int)) as n_blank from {table}"
        for c, out in columns
    )


def _same(names):
    return [(n, n) for n in names]


def _violations(checks):
    return " union all ".join(
        f"select '{name}' as check_name, count(*) as n_violations from ({sql}) v" for name, sql in checks.items()
    )


def _in(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _long(table, keep):
    return " union all ".join(f"select {keep}, '{f}' as field, {f} as value from {table}" for f in FIELDS)


_provenance_text = " || '|' || ".join(f"'{f}=' || {f}_source || ':' || {f}" for f in FIELDS)
_jaccard = f"{canonical('won_company')}"


def oracle_sql() -> dict[str, str]:
    q = {}
    q["ingest_csv"] = renumbered("A")
    q["ingest_csv_multi_line"] = q["ingest_csv"]
    q["ingest_json"] = renumbered("B")
    q["ingest_json_split"] = q["ingest_json"]
    q["html_table_rows"] = PAGES_ + "select page_id, row_no, array_to_string(cells, '|') as cells from kept"
    q["ingest_html"] = renumbered("C")
    q["all_records"] = STD_ + "select id, source, ordinal from std"
    q["source_records_sink"] = STD_ + f"select id, source, raw_json, {FIELD_LIST} from std"
    q["entity_tables_sink"] = MERGED_ + " union all ".join(
        f"select '{name}' as table_name, count(*) as n_rows, count(distinct entity_id) as n_entities from {t}"
        for name, t in (("entities", "entities"), ("field_provenance", "provenance"), ("entity_members", "members"))
    )
    q["files_to_tables"] = MERGED_.replace(
        FRAGS,
        FRAGS.replace("frags as", "frags0 as", 1)
        + f", frags as (select row_number() over (partition by source order by ordinal) as ordinal, source, {_others} from frags0)",
    ) + f"select entity_id, {FIELD_LIST}, confidence, reasoning from entities"
    q["std_state"] = (
        f"with {STATES}, {FRAGS}, cleaned as (select *, {state_clean('state')} as sc from frags) "
        "select source, ordinal, state as raw, coalesce(s1.code, s2.code, upper(sc)) as value from cleaned "
        "left join states s1 on s1.spelling = sc "
        f"left join states s2 on s2.spelling = {trim(chr(32) + "list_extract(string_split(sc, ','), -1)")}"
    )
    q["std_phone"] = FRAGS_ + f"select source, ordinal, phone as raw, {phone('phone')} as value from frags"
    q["std_email"] = FRAGS_ + f"select source, ordinal, email as raw, {email('email')} as value from frags"
    q["std_text"] = FRAGS_ + (
        f"select source, ordinal, {text('company')} as company, {text('contact')} as contact_name from frags"
    )
    q["canonical_company"] = FRAGS_ + f"select source, ordinal, {canonical('company')} as canonical from frags"
    q["block_keys"] = FRAGS_ + (
        f"select source, ordinal, {block_key(canonical('company'), email('email'))} as block_key, "
        f"{block_key(chr(39) * 2, email('email'))} as fallback_key from frags"
    )
    q["standardize_all"] = STD_ + f"select id, source, {FIELD_LIST}, block_key from std"
    q["apply_mapping"] = q["standardize_all"]
    q["raw_roundtrip"] = STD_ + "select id, raw_json, 5 as n_columns, true as same from std"
    patterns = {kind: p.replace("++", "+") for kind, (_, p) in CONTACT_PATTERNS.items()}
    q["doc_contacts"] = f"""with found as (
      select doc_id, 'email' as kind, unnest(regexp_extract_all(text, '{patterns['email']}')) as found from documents
      union all select doc_id, 'phone', unnest(regexp_extract_all(text, '{patterns['phone']}')) from documents)
    select kind, case when kind = 'email' then {email('found')} else {phone('found')} end as value,
      count(*) as n_mentions, count(distinct doc_id) as n_documents from found group by 1, 2"""
    country, area, number = r"(?:\+1|\b1)[-. ]?", r"[0-9]{3}[-. ]?", r"[0-9]{3}[-. ]?[0-9]{4}\b"
    layouts = rf"(?:(?:{country})?\([0-9]{{3}}\)[-. ]?|(?:{country}|\b){area}){number}"
    q["doc_phones"] = f"""with found as (
      select doc_id, unnest(regexp_extract_all(text, '{layouts}')) as found from documents)
    select {phone('found')} as value, count(*) as n_mentions, count(distinct doc_id) as n_documents,
      count(distinct regexp_replace(found, '[0-9]', '9', 'g')) as n_layouts from found group by 1"""
    q["spec_count_state"] = MERGED_ + "select count(*) as count from entities where state = 'CA'"
    q["spec_select_like"] = MERGED_ + (
        f"{_entities_of} where {FOLD.format('email')} like '%marsh%' order by company, id limit 50"
    )
    q["spec_select_confidence"] = MERGED_ + (
        f"{_entities_of} where confidence < 0.93::double and state <> 'IL' order by company, id limit 500"
    )
    q["spec_range_text"] = MERGED_ + (
        f"{_entities_of} where company >= 'Firm2' and company < 'Firm5' order by company, id limit 100"
    )
    q["spec_batch_counts"] = MERGED_ + (
        "select 'how many in california' as question, count(*) as count from entities where state = 'CA' "
        "union all select 'how many certain', count(*) from entities where confidence >= 0.97::double "
        "union all select 'how many vegas outside texas', count(*) from entities where "
        + FOLD.format("contactName")
        + " like '%vega%' and state <> 'TX' "
        "union all select 'not a number', 0 union all select 'all', count(*) from entities"
    )
    def asked(filters):
        parts = []
        for column, op, value in filters:
            if op == "LIKE":
                parts.append(f"{FOLD.format(column)} like '%' || {value} || '%'")
            else:
                parts.append(f"{column} {op} " + (f"cast({value} as double)" if column == "confidence" else f"({value})"))
        return " and ".join(parts)

    kinds = " union all ".join(
        f"select i, count(entity_id) as n from (select unnest(range({queries.N_SPECS})) as i) s left join entities"
        f" on {asked(filters)} where i % 5 = {k} group by i"
        for k, filters in enumerate(queries.SPEC_KINDS)
    )
    q["spec_table_counts"] = MERGED_ + f"select 'q' || cast(i as varchar) as question, n as count from ({kinds})"
    q["unified_view"] = MERGED_ + (
        f"select entity_id, {FIELD_LIST}, confidence, reasoning, {_provenance_text} as provenance, member_count from merged"
    )
    q["entity_member_lists"] = RESOLVED_ + """, placed as (
      select entity_id, id, node, (row_number() over (partition by root order by node) - 1) // 1024 as part,
        (count(*) over (partition by root) + 1023) // 1024 as n_parts from named)
      select entity_id, part, n_parts, string_agg(id, ',' order by node) as members from placed group by entity_id, part, n_parts"""
    q["reloaded_entities"] = MERGED_.replace(
        FRAGS,
        FRAGS.replace("frags as", "frags0 as", 1)
        + """, frags as (select * replace (case when source = 'B' and ordinal % 3 <> 0
          then '2' || substr(phone, 2) else phone end as phone) from frags0)""",
    ) + "select * from entities"
    columns = "ordinal, e, company, contact, phone, email, state"
    five = "frags as (" + " union all ".join(
        f"select '{tag}' as source, {chosen} from ({fragment(s)}) x where {where}"
        for tag, s, where, chosen in (
            ("erp", "A", "true", columns), ("crm-eu", "B", "true", columns),
            ("web", "C", "ordinal % 2 = 0", columns), ("shop", "C", "ordinal % 2 = 1", columns),
            ("lead", "A", "ordinal % 3 = 0", columns.replace("phone", "'' as phone").replace("state", "'' as state")),
        )
    ) + ")"
    order, trust = ("lead", "web", "erp", "shop", "crm-eu"), ("crm-eu", "shop", "erp", "lead", "web")
    five_sql = MERGED_.replace(FRAGS, five)
    five_sql = five_sql.replace(_place, " ".join(f"when source = '{s}' then {i}" for i, s in enumerate(order, 1)))
    five_sql = five_sql.replace(_priority, " ".join(f"when source = '{s}' then {i}" for i, s in enumerate(trust, 1)))
    q["five_source_entities"] = five_sql + (
        f"select entity_id, {FIELD_LIST}, confidence, reasoning, {_provenance_text} as provenance, member_count from merged"
    )
    loads = FRAGS.replace("frags as", "frags0 as", 1) + """, versions as (
      select *, 0 as load from frags0 where source <> 'C' or ordinal % 10 <> 0
      union all select * replace ('2' || substr(phone, 2) as phone), 1 from frags0 where source = 'B' and ordinal % 3 <> 0
      union all select * replace ('Texas' as state), null from frags0 where source = 'C' and ordinal % 5 = 0
      union all select * replace ('Moved ' || company as company), 2 from frags0 where source = 'A' and ordinal % 11 = 0
      union all select * replace ('Moved ' || company as company, 'zz ' || contact as contact), 2
        from frags0 where source = 'A' and ordinal % 22 = 0),
    ranked_loads as (select *, row_number() over (partition by source, ordinal order by load desc nulls last, contact desc) as rn
      from versions),
    frags as (select * exclude (rn) from ranked_loads where rn = 1)"""
    numbered = STD.replace(FRAGS, loads)
    numbered = numbered.replace("select source, ordinal, source ||", "select load, source, ordinal, source ||")
    q["upserted_records"] = f"with {numbered} select id, source, raw_json, {FIELD_LIST}, load from std"
    q["incremental_entities"] = MERGED_.replace(FRAGS, loads) + "select * from entities"
    skewed = STD.replace(
        FRAGS,
        f"frags0 as ({fragment('C')}), frags as (select * replace ('Firm Nought Media' as company, '' as contact, '' as phone,"
        " case when ordinal % 3 = 0 then 'hot@x.example.com' else 'n' || cast(ordinal // 2 as varchar) || '@x.example.com' end"
        " as email) from frags0)",
    )
    by_email = """resolved as (select *, min(node) over (partition by block_key, email) as root,
        count(*) over (partition by block_key, email) > 1 as linked from std),
      named as (select r.*, e.id as entity_id from resolved r join std e on e.node = r.root)"""
    q["skewed_entities"] = f"with {skewed}, {by_email}, {OFFERS}, {RANKED}, {MERGED} " + (
        f"select entity_id, {FIELD_LIST}, confidence, reasoning, member_count from merged"
    )
    q["entity_lineage"] = RESOLVED_ + "select entity_id, id as record_id, source, raw from named"
    q["bucketed_lineage"] = q["entity_lineage"]
    q["field_winner"] = MERGED_ + (
        "select p.entity_id, company, p.source, p.value from provenance p join entities using (entity_id) where field = 'phone'"
    )
    q["bucketed_field_winner"] = q["field_winner"]
    q["published_counts"] = MERGED_ + " union all ".join(
        f"select '{name}' as table_name, count(*) as n_announced, count(*) as n_rows from {t}"
        for name, t in (
            ("source_records", "std"), ("entities", "entities"), ("field_provenance", "provenance"), ("entity_members", "members")
        )
    )
    q["candidate_pairs"] = STD_ + """, firsts as (select block_key, min(node) as node from std group by 1)
    select r.block_key, a.id as anchor_id, r.id as record_id,
      cast(a.email = r.email and r.email <> '' as int) as same_email,
      cast(a.phone = r.phone and regexp_matches(r.phone, '%s') as int) as same_phone,
      cast(lower(a.contactName) = lower(r.contactName) and r.contactName <> '' as int) as same_contact
    from std r join firsts f on f.block_key = r.block_key join std a on a.node = f.node where r.node <> a.node""" % fixed.PHONE_SHAPE
    words = "list_distinct(list_filter(string_split({}.canon, ' '), lambda x: x <> ''))"
    both = f"len(list_intersect({words.format('a')}, {words.format('b')}))::double"
    either = f"len(list_distinct({words.format('a')} || {words.format('b')}))"
    q["neighbour_pairs"] = STD_ + f""", entries as (
      select 0 as order_no, canon || '|' || list_extract(string_split(lower(contactName), ' '), -1) || '|' || lower(contactName) as key,
        * from std where canon <> ''
      union all select 1, phone || '|' || canon, * from std where regexp_matches(phone, '{fixed.PHONE_SHAPE}')
      union all select 2, list_extract(string_split(email, '@'), -1) || '|' || list_extract(string_split(email, '@'), 1), *
        from std where contains(email, '@')),
    placed as (select *, row_number() over (partition by order_no order by key, node) as p from entries),
    close as (select x.order_no, least(x.node, y.node) as first, greatest(x.node, y.node) as second
      from placed x join placed y on x.order_no = y.order_no and y.p > x.p and y.p < x.p + 5),
    once as (select first, second, string_agg(distinct list_extract(['company', 'phone', 'email'], order_no + 1), '+'
        order by case list_extract(['company', 'phone', 'email'], order_no + 1) when 'company' then 0 when 'phone' then 1 else 2 end)
        as orders from (select distinct * from close) group by first, second),
    scored as (select a.id as first_id, b.id as second_id, orders,
      cast(a.email = b.email and a.email <> '' as int) as same_email,
      cast(a.phone = b.phone and regexp_matches(a.phone, '{fixed.PHONE_SHAPE}') as int) as same_phone,
      cast(lower(a.contactName) = lower(b.contactName) and a.contactName <> '' as int) as same_contact,
      cast(a.state = b.state and a.state <> '' as int) as same_state,
      case when {either} = 0 then 0::double else {both} / {either}::double end as company_jaccard,
      levenshtein(lower(a.contactName), lower(b.contactName)) as name_distance
    from once join std a on a.node = first join std b on b.node = second)
    select *, ((same_email * 4 + same_phone * 3 + same_contact * 2 + same_state)::double + 2.0::double * company_jaccard)
      / 12.0::double as score from scored"""
    q["provenance_wide"] = MERGED_ + (
        "select entity_id, " + ", ".join(f"max({f}_source) as {f}" for f in FIELDS) + " from merged group by 1"
    )
    q["source_overlap"] = RESOLVED_ + """select sources, count(*) as n_entities, sum(n) as n_records from (
      select root, string_agg(distinct source, '+' order by source) as sources, count(*) as n from resolved group by root)
      group by sources"""
    blocks = """, blocks as (select block_key, count(*) as n_records,
      %s, min(node) as first_node, count(*)::double * (count(*)::double - 1) / 2 as n_pairs
      from std group by block_key) """ % ", ".join(
        f"count(*) filter (where source = '{s}') as n_{s.lower()}" for s in fixed.SOURCES
    )
    q["block_sizes"] = STD_ + blocks + (
        "select b.block_key, n_records, n_a, n_b, n_c, n_pairs, std.id as first_id from blocks b join std on std.node = first_node"
    )
    q["block_histogram"] = STD_ + blocks + (
        "select n_records as block_size, count(*) as n_blocks, sum(n_records) as n_records, sum(n_pairs) as n_pairs"
        " from blocks group by b.n_records"
    ).replace("from blocks", "from blocks b").replace("select n_records as", "select b.n_records as").replace("sum(n_records)", "sum(b.n_records)")
    q["entity_count"] = MERGED_ + "select count(*) as n from entities"
    q["run_summary"] = RESOLVED_ + (
        "select count(*) as source_records, "
        + ", ".join(f"count(*) filter (where source = '{s}') as records_{s.lower()}" for s in fixed.SOURCES)
        + ", count(distinct root) as unified_entities from resolved"
    )
    q["fragmented_view"] = STD_ + f"select source, id, raw, {FIELD_LIST} from std order by source, id"
    pairs = " union all ".join(f"select entity_id, source, '{f}' as field, {f} as value from named" for f in FIELDS)
    q["field_conflicts"] = RESOLVED_ + f""", said as (select * from ({pairs}) where value <> ''),
    vals as (select entity_id, field, value, count(*) as n_records, string_agg(distinct source, '+' order by source) as sources
      from said group by 1, 2, 3),
    counted as (select *, count(*) over (partition by entity_id, field) as n_values from vals)
    select * from counted where n_values > 1"""
    q["field_provenance"] = MERGED_ + "select entity_id, field, source, id as record_id, value from winners"
    q["block_batches"] = STD_ + blocks + (
        ", numbered as (select block_key, n_records, row_number() over (order by first_node) as block_no from blocks) "
        "select block_key, n_records, block_no, cast(floor((block_no - 1) / 8) as bigint) + 1 as batch from numbered"
    )
    q["batch_progress"] = RESOLVED_ + blocks + """, numbered as (
      select block_key, cast(floor((row_number() over (order by first_node) - 1) / 8) as bigint) + 1 as batch from blocks),
    per as (select batch, count(distinct root) as n_entities from resolved join numbered using (block_key) group by batch)
    select batch, n_entities, sum(n_entities) over (order by batch) as entities_so_far, max(batch) over () as total_batches from per"""
    q["source_samples"] = STD_ + """select source, id, raw, position from (
      select *, row_number() over (partition by source order by ordinal) as position from std) where position <= 3"""
    q["entity_members"] = MERGED_ + "select entity_id, record_id from members"
    q["upsert_latest"] = FRAGS_ + """select id, ordinal, company, contact, phone, email, state from (
      select *, source || cast(e as varchar) as id, row_number() over (partition by source, e order by ordinal desc) as rn
      from frags) where rn = 1"""
    q["link_edges"] = LINKS_ + (
        "select l.block_key, key_type, key_value, hub_size, a.id as anchor_id, r.id as record_id "
        "from links l join std a on a.node = l.anchor join std r on r.node = l.node"
    )
    q["clusters"] = RESOLVED_ + "select id as record_id, block_key, entity_id as cluster_id from named"
    q["entities"] = MERGED_ + "select * from entities"
    forms = {"company": canonical, "contactName": lambda x: f"lower({x})"}
    same = ", ".join(
        f"cast({forms.get(f, str)('n.' + f)} = {forms.get(f, str)('m.' + f)} and n.{f} <> '' as int) as same_{f}" for f in FIELDS
    )
    words = "list_distinct(list_filter(string_split({}, ' '), lambda w: w <> ''))"
    mine, won = words.format("n.canon"), words.format(canonical("m.company"))
    q["pair_scores"] = MERGED_ + f"""select n.entity_id, n.id as record_id, {same},
      case when len(list_distinct(list_concat({mine}, {won}))) = 0 then 0::double
        else len(list_intersect({mine}, {won}))::double / len(list_distinct(list_concat({mine}, {won})))::double end as company_jaccard,
      levenshtein(lower(n.contactName), lower(m.contactName)) as name_distance
      from named n join merged m on m.root = n.root where n.linked"""
    q["column_profile"] = f"with {PROFILE} select * from profile"
    q["field_mapping"] = f"with {MAPPING} select source, source_field, unified_field, score, note from mapping"
    q["unified_schema"] = f"""with {MAPPING}, notes as ({_notes})
      select n.name, n.type, n.description, count(distinct source) as n_sources,
        sum(n_filled)::double / sum(n_rows)::double as fill_rate
      from mapping m join notes n on n.name = m.unified_field group by 1, 2, 3"""
    q["dq_nulls"] = MERGED_ + " union all ".join(
        [
            _blank_rows("std", _same(["id", "source", "raw_json", *FIELDS, "block_key"]), "source_records"),
            _blank_rows("entities", _same(["entity_id", *FIELDS, "reasoning"]), "entities"),
            _blank_rows("provenance", _same(["entity_id", "field", "source", "value"]), "field_provenance"),
            _blank_rows("members", _same(["entity_id", "record_id"]), "entity_members"),
        ]
    )
    sources, fields = _in(fixed.SOURCES), _in(FIELDS)
    q["dq_domains"] = MERGED_ + _violations(
        {
            "record source": f"select 1 from std where source not in {sources} or source is null",
            "provenance source": f"select 1 from provenance where source not in {sources} or source is null",
            "provenance field": f"select 1 from provenance where field not in {fields} or field is null",
            "entity confidence": "select 1 from entities where confidence is null or not confidence between 0 and 1",
        }
    )
    q["dq_orphans"] = MERGED_ + _violations(
        {
            "member record": "select 1 from members where record_id not in (select id from std)",
            "member entity": "select distinct entity_id from members where entity_id not in (select entity_id from entities)",
            "provenance entity": "select distinct entity_id from provenance where entity_id not in (select entity_id from entities)",
        }
    )
    q["dq_keys"] = MERGED_ + _violations(
        {
            "record id": "select id from std group by id having count(*) > 1",
            "entity id": "select entity_id from entities group by entity_id having count(*) > 1",
            "entity member": "select entity_id from members group by entity_id, record_id having count(*) > 1",
            "provenance key": "select entity_id from provenance group by entity_id, field having count(*) > 1",
            "provenance rows": f"select entity_id from provenance group by entity_id having count(*) <> 5"
            f" or count(*) filter (where field in {fields}) <> 5",
        }
    )
    q["dq_partition"] = MERGED_ + _violations(
        {
            "record in one entity": "select id from std left join members on record_id = id group by id having count(record_id) <> 1",
            "entity in one block": "select entity_id from members join std on id = record_id group by entity_id"
            " having count(distinct block_key) > 1",
        }
    )
    q["dq_provenance"] = MERGED_ + f", long_e as ({_long('entities', 'entity_id')}), long_m as ({_long('named', 'entity_id, source')}) " + _violations(
        {
            "entity value": "select 1 from provenance p where not exists (select 1 from long_e e where e.entity_id = p.entity_id"
            " and e.field = p.field and e.value = p.value)",
            "member value": "select 1 from provenance p where not exists (select 1 from long_m e where e.entity_id = p.entity_id"
            " and e.field = p.field and e.value = p.value and e.source = p.source)",
        }
    )
    return q

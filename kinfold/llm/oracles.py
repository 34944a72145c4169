"""The same results in SQL for another engine, where SQL can say them."""

from __future__ import annotations

from kinfold.llm import chat, queries, url_filter


def _url_filter() -> str:
    parts = url_filter.PARTS

    def part(k: int) -> str:
        return f"coalesce(regexp_extract(url, '{parts}', {k}), '')"

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rules = " union all ".join(
        f"select '{text}' as rule, '{text.partition('/')[0]}' as h, '/{text.partition('/')[2]}' as p, '{what}' as v"
        for text, what in queries.URL_RULES
    )
    return f"""with rules as ({rules}),
    split as (select page_id, html, translate({part(1)}, '{upper}', '{lower}') as host, {part(2)} as path, {part(3)} as query
      from pages),
    canon as (select page_id, html, host, path,
        array_to_string(list_sort(list_filter(string_split(query, '&'),
          lambda x: x <> '' and not regexp_matches(x, '{url_filter.TRACKING}'))), '&') as kept from split),
    keyed as (select page_id, html, host, path, case when host <> '' then regexp_replace(host, '^www\\.', '')
        || regexp_replace(path, '/+$', '') || case when kept <> '' then '?' || kept else '' end end as key from canon),
    listed as (select distinct key from keyed where key is not null and regexp_matches(html, '{queries.JUNK_TITLE}')),
    fits as (select page_id, host, path, key, rule, v, row_number() over (partition by page_id, host, path
        order by length(rule) desc nulls last) as rn
      from keyed left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
    select page_id, host, path, rule,
      coalesce(v, case when key in (select key from listed) then 'block' else 'allow' end) as verdict
    from fits where rn = 1"""


def _chat() -> str:
    def times(column: str, what: str) -> str:
        return f"((length({column}) - length(replace({column}, '{what}', ''))) // {len(what)})"

    escapes = " + ".join(times("text", c) for c in ("\\", *chat.CONTROLS))
    roles = " + ".join(f"2 * {times('role', c)}" for c in "%<>[]|")
    roles += " + 2 * (length(role) - length(replace(replace(role, chr(10), ''), chr(13), '')))"
    frame = len(chat.OPEN) + len(chat.CLOSE) + 2
    order = "order by turn nulls first, role, text"
    hostile = queries.HOSTILE
    return f"""with turns as (
      select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
      union all select -1, 0, 'user', '{hostile}' union all select -1, 1, 'assistant', '{hostile}')
    select conv_id, count(*) as n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) as turns_sha256,
      cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
      sha256(coalesce(string_agg(text, '' {order}) filter (where role = 'assistant'), '')) as loss_sha256,
      cast(sum({frame} + length(role) + {roles} + length(text) + {escapes}) as bigint) as formatted_chars
    from turns group by conv_id"""


def crc32(text: str) -> str:
    """CRC-32 of ASCII ``text``, bit by bit."""
    return f"""xor(list_reduce(list_prepend(4294967295::bigint,
      list_transform(string_split({text}, ''), lambda ch: ord(ch)::bigint)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
        lambda d, z: xor(d >> 1, case when d & 1 = 1 then 3988292384 else 0 end))), 4294967295)"""


def _prefix_trie() -> str:
    return f"""with rows as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
        row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as p
      from conversations where conv_id is not null),
    convs as (select c, {crc32("cast(c as varchar)")} % 9 as h from (select distinct conv_id as c from rows)),
    rebuilt as (select c, 0 as own, p, role, text from convs join rows on conv_id = c - c % 5 and p <= h
      union all select c, 1, p, role, text from convs join rows on conv_id = c and p > h),
    placed as (select c, row_number() over (partition by c order by own, p) as depth, role, text from rebuilt),
    lists as (select c, depth, strlen(text) as bytes,
        list([role, text]) over (partition by c order by depth) as prefix from placed),
    prefixes as (select c, depth, bytes, prefix, prefix[:-2] as parent from lists
      union all select c, 0, 0, [], null from convs),
    lengths as (select c, max(depth) as length from prefixes group by c),
    nodes as (select prefix, any_value(parent) as parent, depth, any_value(bytes) as bytes, min(c) as conv_id,
        count(*) as n_convs, sha256(coalesce(string_agg(cast(c as varchar), ',' order by c)
          filter (where depth = length), '')) as ends_sha256
      from prefixes join lengths using (c) group by prefix, depth),
    children as (select parent as prefix, count(*) as n from nodes where depth > 0 group by parent),
    below as (select p.prefix, sum(case when k.n is null then 1 else 0 end) as n_leaves,
        sum((u.n_convs - 1) * u.bytes) as saved
      from nodes u left join children k using (prefix) join prefixes p on p.c = u.conv_id and p.depth <= u.depth
      group by p.prefix)
    select v.conv_id, v.depth, up.conv_id as parent_conv_id, v.n_convs, coalesce(n, 0) as n_children,
      cast(n_leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, v.ends_sha256
    from nodes v join below using (prefix) left join children using (prefix)
    left join nodes up on up.prefix = v.parent and v.depth > 0"""


def _merkle() -> str:
    def leaf(text: str) -> str:
        def part(value: str) -> str:
            value = f"cast({value} as varchar)"
            return f"coalesce(cast(strlen({value}) as varchar) || ':' || {value}, '-')"

        return "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def levels(name: str, leaves: str) -> str:
        return f"""{name} as (select tree, 0 as lvl, p, d, n from {leaves}
      union all select tree, lvl + 1, p // 8, sha256(string_agg(d, '' order by p)), (n + 7) // 8
        from {name} where n > 1 group by tree, lvl, n, p // 8)"""

    def runs(name: str, nodes: str) -> str:
        """Of each node the others of its run, those before and those after it."""
        return f"""{name} as (select a.tree, a.lvl, a.p,
        coalesce(string_agg(b.d, '' order by b.p) filter (where b.p < a.p), '') as before,
        coalesce(string_agg(b.d, '' order by b.p) filter (where b.p > a.p), '') as after
      from {nodes} a join {nodes} b on a.tree = b.tree and a.lvl = b.lvl and a.p // 8 = b.p // 8
      where a.n > 1 group by a.tree, a.lvl, a.p)"""

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""with recursive hashed as (select doc_id, coalesce('=' || lang, '') as tree, {leaf('text')} as leaf,
        case when {crc32("cast(doc_id as varchar)")} % 3 = 0 then {leaf(f"translate(text, '{upper}', '{lower}')")} end as changed
      from documents),
    leaves as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as p,
        count(*) over (partition by tree) as n, leaf as d, row_number() over () as row from hashed),
    {levels('nodes', 'leaves')},
    subroots as (select '' as tree, tree as name, row_number() over (order by tree) - 1 as p,
        count(*) over () as n, d from nodes where n = 1),
    {levels('tops', 'subroots')},
    {runs('low', 'nodes')},
    {runs('high', 'tops')},
    steps as (select row, lvl, before, after from leaves join low
        on low.tree = leaves.tree and low.p = leaves.p // cast(pow(8, lvl) as bigint)
      union all select row, 100 + lvl, before, after from leaves join subroots on name = leaves.tree
        join high on high.p = subroots.p // cast(pow(8, lvl) as bigint)),
    numbered as (select row, before, after, row_number() over (partition by row order by lvl) as k from steps),
    proof as (select row, string_agg(before || after, '' order by k) as path, max(k) as last from numbered group by row),
    folds as (select row, 0 as k, coalesce(changed, leaf) as d from leaves
      union all select folds.row, numbered.k, sha256(before || d || after)
        from folds join numbered on numbered.row = folds.row and numbered.k = folds.k + 1),
    top as (select d as root from tops where n = 1)
    select doc_id, leaf, subroots.d as subroot, root, sha256(coalesce(path, '')) as proof_sha256,
      folds.d as folded_root, folds.d = root as verified
    from leaves join subroots on name = leaves.tree cross join top left join proof using (row)
    join folds on folds.row = leaves.row and folds.k = coalesce(last, 0)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": _url_filter(),
        "op3_chat": _chat(),
        "op11_prefix_trie": _prefix_trie(),
        "op13_merkle": _merkle(),
    }

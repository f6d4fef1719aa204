"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from rateweave.llm.quality import DEFAULT_RULES as Q

WORDS = r"[^\x20\x09-\x0D]+"

_TRIMMED = r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"

CONTENT = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLDED = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"

HOST_SQL = "rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.')"

ORACLES = {
    "op6_url_filter": rf"""
        with p as (select row_number() over () r, page_id n, url, nullif({HOST_SQL}, '') host from pages),
        e as (select distinct lower(case when n % 3 = 0 or (n % 3 = 2 and n % 30 <> 2) then host
                                    when n % 3 = 1 then host || regexp_extract(url, '://[^/?#]+(/[^/?#]+)', 1)
                                    else regexp_replace(host, '^[^.]+\.', '') end) k,
                     'c' || (n % 4)::varchar category, (n * 7 + 11) % 360 t, n % 5 < 2 added from p),
        a as (select k, category, t, bool_or(added) added from e where k is not null group by all),
        i as (select k, category, t since, lead(t) over (partition by k, category order by t) until, added from a),
        w as (select r, n % 360 t, host, string_split(host, '.') labels,
                     list_filter(string_split(regexp_extract(url, '://[^/?#]+(/[^?#]*)', 1), '/'), lambda x: x <> '')[1:3] parts from p),
        c as (select distinct r, t, k from (
                select r, t, unnest(list_concat(
                    list_transform(range(1, len(labels) + 1), lambda j: array_to_string(labels[j:], '.')),
                    list_transform(range(1, len(parts) + 1), lambda j: host || '/' || array_to_string(parts[1:j], '/')))) k from w)),
        h as (select r, c.k, category from c join i on c.k = i.k and added and since <= t and (until is null or t < until)),
        v as (select r, count(*)::bigint n_active, count(distinct category)::bigint n_categories, max((length(k), k)) best from h group by r)
        select n page_id, host, coalesce(n_active, 0)::bigint n_active, coalesce(n_categories, 0)::bigint n_categories,
               best[2] closest, best is null allowed
        from p left join v using (r)""",
    "op5_decontamination": rf"""
        with d as (select row_number() over () r, doc_id, regexp_extract_all({_FOLDED}, '{CONTENT}') ws from documents),
        b as (select item_id, regexp_extract_all({_FOLDED}, '{CONTENT}') ws from benchmark),
        i as (select item_id, ws, least(len(ws), 10) n from b where len(ws) > 0),
        k as (select distinct item_id, n, array_to_string(ws[pos:pos + n - 1], ' ') run
              from (select item_id, ws, n, unnest(range(1, len(ws) - n + 2)) pos from i)),
        p as (select r, n, pos, array_to_string(ws[pos:pos + n - 1], ' ') run
              from (select r, ws, n, unnest(range(1, len(ws) - n + 2)) pos
                    from d cross join (select distinct n from k) where len(ws) >= n)),
        h as (select r, pos, p.n, item_id from p join k on p.n = k.n and p.run = k.run),
        w as (select r, count(distinct word)::bigint n_hit from (select r, unnest(range(pos, pos + n)) word from h) group by r),
        t as (select r, count(*)::bigint n_items, string_agg(x, ',' order by x) listed
              from (select distinct r, item_id::varchar x from h) group by r)
        select doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
               sha256(coalesce(listed, '')) items_sha256, n_hit is not null contaminated
        from d left join w using (r) left join t using (r)""",
    "op10_quality_rules": rf"""
        with t as (select row_number() over () r, doc_id, coalesce(text, '') x from documents),
        w as (select r, doc_id, x, regexp_extract_all(x, '{WORDS}') ws from t),
        c as (select r, doc_id, len(ws)::bigint n_words,
                     coalesce(list_sum(list_transform(ws, lambda z: length(z))), 0)::bigint word_chars,
                     len(regexp_extract_all(x, '[#*$%&|<>]'))::bigint n_symbols from w),
        l as (select r, line from (select r, unnest(string_split(x, chr(10))) line from t)
              where regexp_matches(line, '{WORDS}')),
        m as (select r, line, {_TRIMMED} z from l),
        f as (select r, line, len(regexp_extract_all(z, '{WORDS}')) n,
                     len(regexp_extract_all(z, '{Q.menu_separator}')) marks,
                     len(regexp_extract_all(z, '{Q.noise}')) noise,
                     regexp_matches(z, '{Q.sentence_end.replace("'", "''")}') ended,
                     regexp_matches(lower(z), '{Q.boilerplate}') boiler,
                     length(regexp_replace(z, '[\x20\x09-\x0D]+', '', 'g')) chars from m),
        g as (select r, count(*)::bigint n_lines, (count(*) - count(distinct line))::bigint n_dup_lines,
                     count(*) filter (bad)::bigint n_removed_lines,
                     coalesce(sum(chars) filter (bad), 0)::bigint lost_chars
              from (select *, boiler or (n < {Q.short_line} and not ended)
                             or noise > greatest(1.0, {Q.most_noise} * n)
                             or (marks >= {Q.menu_marks} and n - marks <= {Q.menu_words} * (marks + 1)) bad from f)
              group by r),
        p as (select r, i, array_to_string(ws[i:i + 7], ' ') run
              from (select r, ws, unnest(range(1, len(ws) - 6)) i from w where len(ws) >= 8)),
        d as (select r, i from (select r, i, count(*) over (partition by r, run) k from p) where k > 1),
        n as (select r, sum(least(8, coalesce(nxt, i + 8) - i))::bigint n_repeat_words
              from (select r, i, lead(i) over (partition by r order by i) nxt from d) group by r),
        a as (select c.*, coalesce(n_dup_lines, 0)::bigint n_dup_lines, coalesce(n_repeat_words, 0)::bigint n_repeat_words,
                     coalesce(n_lines, 0)::bigint n_lines, coalesce(n_removed_lines, 0)::bigint n_removed_lines,
                     coalesce(lost_chars, 0)::bigint lost_chars
              from c left join g using (r) left join n using (r)),
        b as (select *, n_words < {Q.fewest_words} or 100 * n_repeat_words > {Q.most_repeated} * n_words base_failed from a)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_removed_lines, lost_chars,
               base_failed, not base_failed and not lost_chars > {Q.most_lost} * word_chars kept from b""",
}


def _crc32(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes; its polynomial bit by bit."""
    hexed = f"hex(encode({text}))"
    octets = f"list_transform(range(1, length({hexed}) // 2 + 1), lambda i: ('0x' || substr({hexed}, 2 * i - 1, 2))::bigint)"
    step = "list_reduce(range(8), lambda x, j: xor(x >> 1, (x & 1) * 3988292384), xor(c, b))"
    return f"xor(4294967295, list_reduce({octets}, lambda c, b: {step}, 4294967295::bigint))"


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::varchar) || ':' || {value}::varchar, '-')"


def _tree(name: str, start: str, levels: int, fan: int = 16) -> list[str]:
    """``{name}0 .. {name}{levels}``: nodes ``(t, p, c, g)`` by level; ``{name}_b0 ..``: what stands beside them."""
    parts = [f"{name}0 as materialized ({start})"]
    for k in range(levels):
        parts.append(f"{name}{k + 1} as materialized (select t, p // {fan} p, (c + {fan - 1}) // {fan} c,"
                     f" sha256(string_agg(g, '' order by p)) g from {name}{k} where c > 1 group by t, p // {fan}, c)")
        run = f"over (partition by t, p // {fan} order by p rows between"
        parts.append(f"{name}_b{k} as (select t, p, coalesce(string_agg(g, '') {run} unbounded preceding and 1 preceding), '') l,"
                     f" coalesce(string_agg(g, '') {run} 1 following and unbounded following), '') r from {name}{k} where c > 1)")
    return parts


def _climb(name: str, source: str, tree: str, levels: int, fan: int = 16) -> list[str]:
    """``{name}0 .. {name}{levels}``: rows of ``source`` with ``proof`` and ``f``, folded one level further each."""
    parts = [f"{name}0 as (select * from {source})"]
    for k in range(levels):
        parts.append(f"{name}{k + 1} as (select x.* exclude (proof, f), proof || coalesce(l || b.r, '') proof,"
                     f" case when b.p is null then f else sha256(l || f || b.r) end f"
                     f" from {name}{k} x left join {tree}_b{k} b on x.t = b.t and x.p // {fan ** k} = b.p)")
    return parts


def _merkle(levels: int = 5, above: int = 3) -> str:
    """Enough levels for 16 ** 5 rows a source and 16 ** 3 sources."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = f"case when {_crc32('doc_id::varchar')} % 5 = 0 then translate(text, '{_UPPER}', '{_UPPER.lower()}') else text end"
    whole = " || ".join(map(_field, fields))
    other = " || ".join(map(_field, [*fields[:-1], "changed"]))

    def tops(tree, n):
        return " union all ".join(f"select t, g from {tree}{k} where c = 1" for k in range(n + 1))

    parts = [
        f"w as (select row_number() over () r, *, {changed} changed from documents)",
        f"d as materialized (select doc_id, coalesce('=' || source, '') t, sha256({whole}) leaf, sha256({other}) f, r from w)",
        "n as materialized (select *, row_number() over (partition by t order by doc_id nulls first, leaf, r) - 1 p,"
        " count(*) over (partition by t) c from d)",
        *_tree("m", "select t, p, c, leaf g from n", levels), f"s as materialized ({tops('m', levels)})",
        "o as materialized (select t name, 0 t, row_number() over (order by t) - 1 p, count(*) over () c, g from s)",
        *_tree("u", "select t, p, c, g from o", above), f"root as ({tops('u', above)})",
        *_climb("x", "(select doc_id, t, p, leaf, '' proof, f from n)", "m", levels),
        f"y as (select doc_id, leaf, g subroot, o.t, o.p, proof, f from x{levels} x join o on x.t = o.name)",
        *_climb("z", "y", "u", above)]
    return "with " + ",\n".join(parts) + f"""
        select doc_id, leaf, subroot, root.g root, sha256(proof) proof_sha256, f folded_root, f = root.g verified
        from z{above}, root"""


ORACLES["op13_merkle"] = _merkle()
ORACLES["op11_spelling"] = f"""
    with recursive r as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) raw from documents),
    d as (select doc_id, translate(raw, '{_UPPER}', '{_UPPER.lower()}') w, count(*) c from r where length(raw) >= 5 group by all),
    h as (select w, c, {_crc32("coalesce(doc_id::varchar, '') || ':' || w")} h from d),
    x as (select case when h % 97 = 0 then left(w, h % length(w)) || substr(w, h % length(w) + 2) else w end word, c from h),
    v as materialized (select word, sum(c)::bigint n from x where length(word) >= 5 group by word having sum(c) >= 3),
    p as (select word, unnest(range(1, length(word) + 1)) i from v),
    k as materialized (select word, i, left(word, i - 1) || substr(word, i + 1) part from p),
    l as (select a.word a, b.word b from k a join k b on a.part = b.part and a.i = b.i and a.word <> b.word
          union select k.word, v.word from k join v on part = v.word
          union select v.word, k.word from k join v on part = v.word),
    o as (select a, b, n, count(*) over (partition by a) n_near, row_number() over (partition by a order by n desc, b) o
          from l join v on b = word),
    f as materialized (select v.word, case when o.n >= 2 * v.n then b end form, v.n, coalesce(n_near, 0)::bigint n_near,
                              case when o.n >= 2 * v.n then o.n end form_n
                       from v left join o on a = word and o = 1),
    t(word, root, form) as (select word, word, form from f
                            union all select t.word, f.word, f.form from t join f on t.form = f.word)
    select word, f.form, t.root, n, n_near, form_n from f join t using (word) where t.form is null"""

"""DuckDB SQL for the registered queries, over the same tables and whole."""

from __future__ import annotations

from workload.views import with_views

PENDING = "pending as (select id, item_ids from users where id <> 610 and item_ids is not null and job_status is null)"
ALL_PICKS = "all_picks as (select id user_id, cast(unnest(string_split(item_ids, ',')) as int) item_id from pending)"
PICKS = f"{PENDING},\n{ALL_PICKS},\npicks as (select distinct user_id, item_id from all_picks)"
GENRES = "genres as (select item_id, unnest(string_split(genres, '|')) genre from items)"
PROFILES = """
values_ as (select item_id, unnest(features) v, generate_subscripts(features, 1) pos from item_factors),
sums as (select user_id, pos, sum(5.0 * cast(v as double)) s from picks join values_ using (item_id) group by all),
profiles as (select user_id, list(s order by pos) f from sums group by user_id)"""
SCORES = """
scores as (
    select user_id, item_id, list_dot_product(f, cast(features as double[])) score
    from profiles, {items}
    where not exists (select 1 from picks p where p.user_id = profiles.user_id and p.item_id = {items}.item_id)),
top as (
    select user_id, item_id, score, row_number() over (partition by user_id order by score desc, item_id) rank
    from scores qualify rank <= {k})"""
LINKS = """
item_links as (
    select item_id, min(ext_id) ext_id,
           'https://www.imdb.com/title/tt' || repeat('0', greatest(0, 7 - length(min(ext_id)))) || min(ext_id) || '/' link
    from links where ext_id is not null group by item_id)"""
WEIGHTED = "weighted as (select r.*, len(string_split(genres, '|')) w, title from ratings r join items using (item_id))"


def _q(views: str, *parts: str) -> str:
    *ctes, final = parts
    return "with " + ",\n".join([with_views(*views.split()), *ctes]) + "\n" + final


def _grains(views: str, template: str, *ctes: str) -> str:
    """The same statement for both grains, ``{w}`` being the weight of a rating."""
    both = "\nunion all\n".join(f"select *, '{grain}' grain from ({template.format(w=w)})"
                                for grain, w in (("rating", "1"), ("rating_genre", "w")))
    return _q(views, WEIGHTED, *ctes, both)


def _generous(w: str) -> str:
    return f"(select user_id from weighted group by user_id having sum(cast(rating as double) * {w}) / sum({w}) >= 3)"


def _rank1_sweeps(sweeps: int) -> list[str]:
    parts = ["r as materialized (select user_id, item_id, cast(rating as double) rating from ratings where rating > 0.5)",
             "v0 as materialized (select distinct item_id, 1.0 + (item_id % 10) / 10.0 f from r)"]
    for s in range(1, sweeps + 1):
        parts.append(f"u{s} as materialized (select user_id, sum(rating * f) / (sum(f * f) + 0.1) f"
                     f" from r join v{s - 1} using (item_id) group by user_id)")
        parts.append(f"v{s} as materialized (select item_id, sum(rating * f) / (sum(f * f) + 0.1) f"
                     f" from r join u{s} using (user_id) group by item_id)")
    return [p.replace("1.0 + (item_id % 10) / 10.0", "cast(1.0 + (item_id % 10) / 10.0 as double)") for p in parts]


def _rank2_sweeps(sweeps: int) -> list[str]:
    """The 2 x 2 normal equations solved by their determinant."""
    parts = ["r as materialized (select user_id, item_id, cast(rating as double) rating from ratings where rating > 0.5)",
             "v0 as materialized (select distinct item_id, cast(1.0 + (item_id % 10) / 10.0 as double) f,"
             " cast(1.0 + (item_id % 7) / 7.0 as double) g from r)"]

    def side(name, key, fixed, fixed_key):
        return (f"{name} as materialized (select {key}, (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12) f,"
                f" (b2 * a11 - b1 * a12) / (a11 * a22 - a12 * a12) g from (select {key}, sum(f * f) + 0.1 a11,"
                f" sum(f * g) a12, sum(g * g) + 0.1 a22, sum(rating * f) b1, sum(rating * g) b2"
                f" from r join {fixed} using ({fixed_key}) group by {key}))")

    for s in range(1, sweeps + 1):
        parts += [side(f"u{s}", "user_id", f"v{s - 1}", "item_id"), side(f"v{s}", "item_id", f"u{s}", "user_id")]
    return parts


def _implicit_sweeps(sweeps: int) -> list[str]:
    """Implicit feedback at rank 2: confidence 1 + 0.01 |rating|, ridge 0.1 for every like."""
    parts = ["r as materialized (select user_id, item_id, 0.01::double * abs(rating::double) c,"
             " case when rating > 0 then 1.0::double else 0.0::double end liked from ratings)",
             "v0 as materialized (select distinct item_id, cast(1.0 + (item_id % 10) / 10.0 as double) f,"
             " cast(1.0 + (item_id % 7) / 7.0 as double) g from r)"]

    def side(name, key, fixed, fixed_key):
        return (f"{name} as materialized (select {key}, (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12) f,"
                f" (b2 * a11 - b1 * a12) / (a11 * a22 - a12 * a12) g from (select {key},"
                f" ff + sum(c * f * f) + 0.1::double * sum(liked) a11, fg + sum(c * f * g) a12,"
                f" gg + sum(c * g * g) + 0.1::double * sum(liked) a22, sum(liked * (1 + c) * f) b1, sum(liked * (1 + c) * g) b2"
                f" from r join {fixed} using ({fixed_key}),"
                f" (select sum(f * f) ff, sum(f * g) fg, sum(g * g) gg from {fixed}) group by {key}, ff, fg, gg))")

    for s in range(1, sweeps + 1):
        parts += [side(f"u{s}", "user_id", f"v{s - 1}", "item_id"), side(f"v{s}", "item_id", f"u{s}", "user_id")]
    return parts


def _explicit_sweeps(sweeps: int) -> list[str]:
    """Ratings at rank 2 with ridge 0.1 for every rating of a key."""
    parts = ["r as materialized (select user_id, item_id, rating::double rating from ratings)",
             "v0 as materialized (select distinct item_id, cast(1.0 + (item_id % 10) / 10.0 as double) f,"
             " cast(1.0 + (item_id % 7) / 7.0 as double) g from r)"]

    def side(name, key, fixed, fixed_key):
        return (f"{name} as materialized (select {key}, (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12) f,"
                f" (b2 * a11 - b1 * a12) / (a11 * a22 - a12 * a12) g from (select {key}, sum(f * f) + 0.1::double * count(*) a11,"
                f" sum(f * g) a12, sum(g * g) + 0.1::double * count(*) a22, sum(rating * f) b1, sum(rating * g) b2"
                f" from r join {fixed} using ({fixed_key}) group by {key}))")

    for s in range(1, sweeps + 1):
        parts += [side(f"u{s}", "user_id", f"v{s - 1}", "item_id"), side(f"v{s}", "item_id", f"u{s}", "user_id")]
    return parts


def _biased_sweeps(sweeps: int) -> list[str]:
    """One factor ``f`` with ridge 2 and a bias ``b`` with ridge 0.1."""
    parts = ["r as materialized (select user_id, item_id, rating::double rating from ratings)",
             "v0 as materialized (select distinct item_id, cast(1.0 + (item_id % 10) / 10.0 as double) f, 0::double b from r)"]

    def side(name, key, fixed, fixed_key):
        return (f"{name} as materialized (select {key}, (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12) f,"
                f" (b2 * a11 - b1 * a12) / (a11 * a22 - a12 * a12) b from (select {key}, sum(f * f) + 2::double a11,"
                f" sum(f) a12, count(*) + 0.1::double a22, sum((rating - b) * f) b1, sum(rating - b) b2"
                f" from r join {fixed} using ({fixed_key}) group by {key}))")

    for s in range(1, sweeps + 1):
        parts += [side(f"u{s}", "user_id", f"v{s - 1}", "item_id"), side(f"v{s}", "item_id", f"u{s}", "user_id")]
    return parts


#: The pending users' factors over the items of ``v2``: five points for a pick, confidence 1 + 0.01 * 5, ridge 0.1 a pick.
FOLDED = """
folded as (select user_id, (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12) f, (b2 * a11 - b1 * a12) / (a11 * a22 - a12 * a12) g
           from (select user_id, ff + 0.05::double * sum(f * f) + 0.1::double * count(*) a11, fg + 0.05::double * sum(f * g) a12,
                        gg + 0.05::double * sum(g * g) + 0.1::double * count(*) a22, 1.05::double * sum(f) b1, 1.05::double * sum(g) b2
                 from picks join v2 using (item_id), (select sum(f * f) ff, sum(f * g) fg, sum(g * g) gg from v2)
                 group by user_id, ff, fg, gg))"""

RANK2_ROWS = " union all ".join(
    f"select '{side}' side, {side}_id id, cast({pos} as int) pos, round({c}, 6) as value from {name}"
    for side, name in (("user", "u2"), ("item", "v2")) for pos, c in ((0, "f"), (1, "g")))


def _bias_sweeps(source: str, sweeps: int) -> list[str]:
    parts = [f"r as materialized (select user_id, item_id, cast(rating as double) rating from {source})",
             "bi0 as materialized (select distinct item_id, cast(0 as double) b from r)"]
    for s in range(1, sweeps + 1):
        parts.append(f"bu{s} as materialized (select user_id, sum(rating - b) / (count(*) + 0.1) b"
                     f" from r join bi{s - 1} using (item_id) group by user_id)")
        parts.append(f"bi{s} as materialized (select item_id, sum(rating - b) / (count(*) + 0.1) b"
                     f" from r join bu{s} using (user_id) group by item_id)")
    return parts


MARKED = ("marked as (select user_id, item_id, rating,"
          " substr(md5(user_id || '-' || item_id || '-42'), 1, 8) < 'cccccccc' is_train from ratings)")

ORACLES = {
    "item_rating_stats": _q("ratings items", """
        select item_id, title, count(rating) n_ratings, round(avg(cast(rating as double)), 6) mean_rating
        from ratings join items using (item_id) group by item_id, title"""),
    "stored_item_stats": _q("ratings items", """
        select item_id, title, count(rating) n_ratings, round(avg(cast(rating as double)), 6) mean_rating
        from ratings join items using (item_id) group by item_id, title"""),
    "stored_generous_reviews": _q("ratings", """
        select item_id, count(*) n_reviews from ratings
        where user_id in (select user_id from ratings group by user_id having avg(cast(rating as double)) >= 3) group by item_id"""),
    "stored_pairs": _q("ratings", """
        select user_id, item_id, count(rating) n, sum(cast(rating as double)) total
        from ratings where rating is not null group by user_id, item_id"""),
    "items_mean_at_least": _q("ratings items", """
        select item_id, title, count(rating) n_ratings, round(avg(cast(rating as double)), 6) mean_rating
        from ratings join items using (item_id) group by item_id, title having avg(cast(rating as double)) >= 2.5"""),
    "user_means": _grains("ratings items", """
        select user_id, cast(sum({w}) as bigint) n,
               round(sum(cast(rating as double) * {w}) / sum({w}), 6) mean_rating from weighted group by user_id"""),
    "rating_histogram": _q("ratings", """
        b as (select min(cast(rating as double)) lo, max(cast(rating as double)) hi from ratings),
        placed as (select least(5, 1 + cast(floor((cast(rating as double) - lo) / ((hi - lo) / 5)) as int)) bin, count(*) n
                   from ratings, b group by 1)""", """
        select cast(bin as int) bin, round(lo + (bin - 1) * (hi - lo) / 5, 6) low, round(lo + bin * (hi - lo) / 5, 6) high,
               coalesce(n, 0) n
        from (select unnest(range(1, 6)) bin) left join placed using (bin), b"""),
    "genre_counts": _q("ratings items", GENRES, """
        select genre, count(rating) n_ratings from ratings join genres using (item_id) group by genre"""),
    "genre_cloud": _q("ratings items", GENRES, """
        select genre, count(rating) n_ratings from ratings join genres using (item_id) group by genre
        order by n_ratings desc, genre limit 500"""),
    "genre_year_mean": _q("ratings items", GENRES, """
        select genre, cast(year(rated_at) as int) as year, count(rating) n_ratings,
               round(avg(cast(rating as double)), 6) mean_rating
        from ratings join genres using (item_id) group by 1, 2"""),
    "genre_year_slices": _q("ratings items", GENRES, """
        ordered as (select genre, row_number() over (order by genre) o from (select distinct genre from ratings join genres using (item_id)))""",
        """
        select case when o <= 9 then 'first' else 'rest' end slice, genre, cast(year(rated_at) as int) as year,
               count(rating) n_ratings, round(avg(cast(rating as double)), 6) mean_rating
        from ratings join genres using (item_id) join ordered using (genre)
        where genre <> '(no genres listed)' group by 1, 2, 3"""),
    "item_genre_mean": _q("ratings items", GENRES, """
        select item_id, genre, round(avg(cast(rating as double)), 6) mean_rating
        from ratings join genres using (item_id) group by item_id, genre"""),
    "genre_density": _q("ratings items", GENRES, """
        m as (select genre, item_id, avg(cast(rating as double)) v from ratings join genres using (item_id)
              where genre <> '(no genres listed)' group by genre, item_id),
        shape as (select genre, count(*) n, min(v) lo, max(v) hi, stddev_samp(v) * pow(count(*), -0.2) h
                  from m group by genre having count(*) > 1 and max(v) > min(v)),
        grid as (select genre, n, h, point, lo - 3 * h + point * (hi - lo + 6 * h) / 99 x
                 from shape, (select unnest(range(0, 100)) point))""", """
        select genre, cast(point as int) point, round(x, 6) x,
               round(sum(exp(-0.5 * pow((x - v) / h, 2))) / (n * h * sqrt(2 * pi())), 6) density
        from grid join m using (genre) group by genre, point, x, n, h"""),
    "top_titles_by_rating": _grains("ratings items", """
        select title, cast(sum({w}) as bigint) n_ratings from weighted group by title
        order by n_ratings desc, title limit 20"""),
    "release_year_reviews": _q("ratings items", WEIGHTED, "\nunion all\n".join(f"""
        select *, '{grain}' grain from (
            select substring(title, -5, 4) release_year, cast(sum({w}) as bigint) n_reviews from weighted
            where user_id in {_generous(w)} group by 1 order by n_reviews desc, release_year limit 50)"""
        for grain, w in (("rating", "1"), ("rating_genre", "w")))),
    "genre_reviews": _q("ratings items", WEIGHTED, GENRES, f"""
        select genre, count(*) n_reviews from ratings join genres using (item_id)
        where user_id in {_generous("w")} group by genre"""),

    "items_never_rated": _q("ratings items item_pages", """
        select * from items i where not exists (select 1 from ratings r join item_pages p using (item_id)
                                                where r.item_id = i.item_id)"""),
    "items_never_picked": _q("users items", """
        p as (select cast(unnest(string_split(item_ids, ',')) as int) item_id from users where item_ids is not null)""",
        "select * from items i where not exists (select 1 from p where p.item_id = i.item_id)"),
    "items_rated": _q("ratings items", "select * from items where item_id in (select item_id from ratings)"),
    "distinct_counts": _q("ratings", """
        select count(distinct user_id) n_users, count(distinct item_id) n_items from ratings"""),
    "dense_ids": _q("ratings", """
        u as (select user_id, min(row(rated_at, item_id)) f from ratings group by 1),
        i as (select item_id, min(row(rated_at, user_id)) f from ratings group by 1)""", """
        select 'user' kind, user_id id, row_number() over (order by f, user_id) - 1 idx from u
        union all select 'item', item_id, row_number() over (order by f, item_id) - 1 from i"""),
    "growing_ids": _q("ratings", "\n,".join(f"""
        {k}1 as (select {k}_id id, min(row(rated_at, {o}_id)) f from ratings where rated_at < date '1992-06-01' group by 1),
        {k}2 as (select {k}_id id, min(row(rated_at, {o}_id)) f from ratings where {k}_id not in (select id from {k}1) group by 1)"""
        for k, o in (("user", "item"), ("item", "user"))), " union all ".join(f"""
        select '{k}' kind, id, row_number() over (order by f, id) - 1 idx, 1::bigint batch from {k}1
        union all select '{k}', id, (select count(*) from {k}1) + row_number() over (order by f, id) - 1, 2 from {k}2"""
        for k in ("user", "item"))),
    "dense_ratings": _q("ratings", """
        u as (select user_id, row_number() over (order by min(row(rated_at, item_id)), user_id) - 1 user_idx
              from ratings group by 1),
        i as (select item_id, row_number() over (order by min(row(rated_at, user_id)), item_id) - 1 item_idx
              from ratings group by 1)""", """
        select user_idx, item_idx, cast(rating as double) rating
        from ratings join u using (user_id) join i using (item_id)"""),
    "pick_list_rows": _q("users", """
        l as (select id, unnest(string_split(item_ids, ',')) pick,
                     generate_subscripts(string_split(item_ids, ','), 1) - 1 pos from users where item_ids is not null)""",
        """
        select id, pick, '#' || pick padded, cast(pos as int) pos from l
        union all select id, '', '', 0 from users where item_ids is null"""),
    "title_lookup": _q("users items", """
        w as (select id user_id, cast(unnest(string_split(item_ids, ',')) as int) item_id,
                     generate_subscripts(string_split(item_ids, ','), 1) pos from users where item_ids is not null),
        by_title as (select title, min(item_id) item_id from items group by title)""", """
        select user_id, string_agg(cast(b.item_id as varchar), ',' order by pos) item_ids
        from w join items i using (item_id) join by_title b on b.title = i.title group by user_id"""),
    "title_prefix": _q("items", "select item_id, title from items where upper(substring(title, 1, 5)) = 'RED W'"),
    "user_by_name": _q("users", "select id, item_ids from users where name = 'Customer#000000001'"),
    "pending_users": _q("users", PENDING, "select * from pending"),
    "user_status": _q("users", """
        select id, case when item_ids is null then 'no_picks' when job_status = 'done' then 'ready' else 'pending' end status
        from users"""),
    "new_user_ids": _q("users sign_ups", """
        f as (select name, min(ordinal) ordinal from sign_ups where name not in (select name from users) group by name)""",
        "select (select max(id) from users) + row_number() over (order by ordinal) id, name from f"),
    "next_user_id": _q("users", "select cast(max(id) + 1 as bigint) next_id from users"),
    "display_names": _q("users", "select id, upper(name[1]) || lower(name[2:]) display_name from users"),
    "csv_ratings": _q("ratings", """
        select user_id, item_id, cast(rating as double) rating, cast(year(rated_at) as int) as year from ratings"""),
    "typed_ratings": _q("ratings", """
        select user_id, item_id, cast(rating as double) rating, cast(year(rated_at) as int) as year from ratings"""),
    "ratings_with_new_users": _q("ratings users", PENDING, ALL_PICKS, """
        select user_id, item_id, cast(rating as double) rating from ratings
        union all select user_id, item_id, cast(5 as double) from all_picks"""),
    "unrated_candidates": _q("ratings users", PICKS, "known as (select distinct item_id from ratings)", """
        select user_id, count(*) n_candidates from (select distinct user_id from picks) u, known k
        where not exists (select 1 from picks p where p.user_id = u.user_id and p.item_id = k.item_id)
        group by user_id"""),

    "profile_vector_values": _q("users item_factors", PICKS, PROFILES, """
        select user_id, cast(pos - 1 as int) pos, round(s, 6) as value from sums"""),
    "pick_affinity": _q("users item_factors", PICKS, PROFILES, """
        select user_id, item_id, round(list_dot_product(f, cast(features as double[])), 6) prediction
        from picks join profiles using (user_id) join item_factors using (item_id)"""),
    "quick_top12": _q("users item_factors", PICKS, PROFILES, SCORES.format(items="item_factors", k=12),
                      "select user_id, item_id, round(score, 6) score, cast(rank as int) rank from top"),
    "relabelled_scores": _q("users item_factors", PICKS, PROFILES, SCORES.format(items="item_factors", k=12), """
        select name user_id, item_id, round(score, 6) score, cast(rank as int) rank from top join users on id = user_id"""),
    "personal_top48_given_factors": _q("users item_factors links item_pages", PICKS, PROFILES, LINKS, """
        available as (select item_id, features from item_links join item_pages using (item_id) join item_factors using (item_id)
                      where status = 200 and regexp_matches(html, '<li><a href="[^"]*"'))""",
        SCORES.format(items="available", k=48),
        "select user_id, item_id, round(score, 6) score, cast(rank as int) rank from top"),
    "factor_round_trip": _q("item_factors", """
        select item_id, cast(generate_subscripts(features, 1) - 1 as int) pos,
               round(cast(unnest(features) as double), 6) as value from item_factors"""),
    "relative_order": _q("users", """
        a as (select id list_id, cast(unnest(string_split(item_ids, ',')) as int) item,
                     cast(generate_subscripts(string_split(item_ids, ','), 1) - 1 as int) pos
              from users where item_ids is not null),
        present as (select list_id, pos, item, row_number() over (partition by list_id order by pos) slot,
                           row_number() over (partition by list_id order by s_acctbal, s_suppkey, pos) place
                    from a join supplier on s_suppkey = item)""", """
        select a.list_id, a.pos, coalesce(v.item, -1) as value
        from a left join present s on s.list_id = a.list_id and s.pos = a.pos
        left join present v on v.list_id = s.list_id and v.place = s.slot"""),

    "ext_links": _q("links", LINKS, "select * from item_links"),
    "available_items": _q("links item_pages", LINKS, """
        select item_id, link from item_links join item_pages using (item_id) where status = 200"""),
    "page_attributes": _q("item_pages", """
        v as (select item_id, regexp_extract_all(html, '<li><a href="([^"]*)"', 1) l from item_pages)""", """
        select item_id, cast(generate_subscripts(l, 1) - 1 as int) pos, unnest(l) as value from v"""),
    "enriched_top12": _q("users items item_factors links item_pages", PICKS, PROFILES, LINKS, """
        available as (select item_id, link, features, regexp_extract(html, '<li><a href="([^"]*)"', 1) image_link
                      from item_links join item_pages using (item_id) join item_factors using (item_id)
                      where status = 200)""", SCORES.format(items="available", k=12), """
        select user_id, cast(rank as int) rank, item_id, title, round(score, 6) prediction, link, image_link
        from top join available using (item_id) join items using (item_id)"""),

    "als_rank1": _q("ratings", *_rank1_sweeps(2), """
        select 'user' side, user_id id, cast(0 as int) pos, round(f, 6) as value from u2
        union all select 'item', item_id, 0, round(f, 6) from v2"""),
    "als_rank2": _q("ratings", *_rank2_sweeps(2), RANK2_ROWS),
    "als_rank2_wide": _q("ratings", *_rank2_sweeps(2), RANK2_ROWS),
    "implicit_als_rank2": _q("ratings", *_implicit_sweeps(2), RANK2_ROWS),
    "implicit_als_rank2_wide": _q("ratings", *_implicit_sweeps(2), RANK2_ROWS),
    "explicit_als_rank2": _q("ratings", *_explicit_sweeps(2), RANK2_ROWS),
    "explicit_als_rank2_wide": _q("ratings", *_explicit_sweeps(2), RANK2_ROWS),
    "folded_in_users": _q("ratings users", PICKS, *_implicit_sweeps(2), FOLDED, """
        select user_id, cast(0 as int) pos, round(f, 6) as value from folded
        union all select user_id, 1, round(g, 6) from folded"""),
    "folded_in_top48": _q("ratings users", PICKS, *_implicit_sweeps(2), FOLDED, """
        s as (select u.user_id, v.item_id, u.f * v.f + u.g * v.g score from folded u, v2 v
              where not exists (select 1 from picks p where p.user_id = u.user_id and p.item_id = v.item_id))""", """
        select user_id, item_id, round(score, 6) score,
               cast(row_number() over (partition by user_id order by s.score desc, item_id) as int) rank from s qualify rank <= 48"""),
    "biased_one_factor": _q("ratings", *_biased_sweeps(2), """
        select 'user' side, user_id id, round(f, 6) factor, round(b, 6) bias from u2
        union all select 'item', item_id, round(f, 6), round(b, 6) from v2"""),
    "implicit_top48": _q("ratings users", PICKS, *_implicit_sweeps(2), """
        s as (select u.user_id, v.item_id, u.f * v.f + u.g * v.g score
              from (select * from u2 where user_id in (select id from pending)) u, v2 v
              where not exists (select 1 from picks p where p.user_id = u.user_id and p.item_id = v.item_id))""", """
        select user_id, item_id, round(score, 6) score,
               cast(row_number() over (partition by user_id order by s.score desc, item_id) as int) rank from s qualify rank <= 48"""),
    "als_error": _q("ratings", *_rank1_sweeps(2), " union all ".join(f"""
        select cast({s} as int) sweep, round(sum(pow(rating - u.f * v.f, 2)), 4) error
        from r join u{s} u using (user_id) join v{s} v using (item_id)""" for s in (1, 2))),
    "als_residual": _q("ratings", *_rank1_sweeps(2), """
        select count(*) n, round(sum(pow(rating - u.f * v.f, 2)), 4) squared_error,
               round(avg(pow(rating - u.f * v.f, 2)), 4) mse
        from r join u2 u using (user_id) join v2 v using (item_id)"""),
    "als_predict": _q("ratings", *_rank1_sweeps(2), """
        select user_id, item_id, round(u.f * v.f, 6) prediction
        from (select distinct user_id, item_id from ratings) join u2 u using (user_id) join v2 v using (item_id)"""),
    "holdout_split": _q("ratings", MARKED, """
        select is_train, count(*) n, sum(cast(rating as double)) total from marked group by is_train"""),
    "bias_validation": _q("ratings", MARKED, *_bias_sweeps("marked where is_train", 3), """
        e as (select pow(cast(rating as double) - bu3.b - bi3.b, 2) e
              from marked join bu3 using (user_id) join bi3 using (item_id) where not is_train)""", """
        select count(*) n, round(sum(e), 6) squared_error, round(avg(e), 6) mse from e"""),
    "item_bias_best_worst": _q("ratings items", *_bias_sweeps("ratings", 3), """
        c as (select item_id, count(*) n_ratings from ratings group by item_id
              order by n_ratings desc, item_id limit 3000),
        named as (select item_id, title, n_ratings, round(b, 6) bias
                  from c join bi3 using (item_id) join items using (item_id))""", """
        select 'worst' list, cast(row_number() over (order by bias, n_ratings desc, item_id) as int) rank, *
        from named qualify rank <= 15
        union all
        select 'best', cast(row_number() over (order by bias desc, n_ratings desc, item_id) as int) rank, *
        from named qualify rank <= 48"""),
}
ORACLES["stream_quick_top12"] = _q(
    "users item_factors", PICKS, PROFILES, SCORES.format(items="item_factors", k=12),
    "select user_id, cast(rank as int) rank, item_id from top")

"""SQL that DuckDB runs beside the queries: streams, segments, features and routing as CTEs."""

from __future__ import annotations

from stratadup.config import RoutingConfig
from stratadup.functions.fingerprints import MULTIPLIERS, OFFSETS, SPAN


def _blocks(trace: str, key: str, text: str, table: str, size: int = 64) -> str:
    return (
        f"select trace, file_no, i as chunk_no, substr(md5(substr(t, cast(i * {size} + 1 as bigint), {size})), 1, 12) as fp "
        f"from (select {trace} as trace, {key} as file_no, {text} as t, unnest(range(0, (length({text}) + {size - 1}) // {size})) as i from {table} where length({text}) > 0)"
    )


STREAMS = {
    "documents": _blocks("source", "doc_id", "text", "documents"),
    "document_lines": "select trace, file_no, k - 1 as chunk_no, substr(md5(p), 1, 12) as fp from (select source as trace, doc_id as file_no, unnest(string_split(text, chr(10))) as p, "
    "unnest(range(1, len(string_split(text, chr(10))) + 1)) as k from documents where length(text) > 0)",
    "pages": _blocks("'pages'", "page_id", "html", "pages"),
    "conversations": "select role as trace, conv_id as file_no, turn as chunk_no, substr(md5(text), 1, 12) as fp from conversations",
    "events": "select event_type as trace, event_id as file_no, cast(0 as bigint) as chunk_no, substr(md5(concat_ws('|', cast(user_id as varchar), event_type, props)), 1, 12) as fp from events",
    "lineitem": "select 'lineitem' as trace, l_orderkey as file_no, cast(l_linenumber - 1 as bigint) as chunk_no, substr(md5(concat_ws('|', cast(l_partkey as varchar), cast(l_suppkey as varchar), l_returnflag, l_linestatus)), 1, 12) as fp from lineitem",
}


def byte(fp: str, i: int) -> str:
    return f"cast('0x' || substr({fp}, {2 * i + 1}, 2) as bigint)"


def little_endian(fp: str, n: int) -> str:
    return f"cast('0x' || {' || '.join(f'substr({fp}, {2 * i + 1}, 2)' for i in reversed(range(n)))} as bigint)"


def boundary(fp: str, span: int) -> str:
    return f"({little_endian(fp, 4)} % {span} = 0)"


def chunks(stream: str, backups: int = 1) -> str:
    source = STREAMS[stream]
    if backups > 1:
        source = f"select printf('%04d', b) || '/' || trace as trace, file_no, chunk_no, fp from ({source}), range(0, {backups}) t(b)"
    return f"raw as ({source}), chunks as (select *, row_number() over (partition by trace order by file_no, chunk_no, fp) as pos from raw)"


def segments(cfg: RoutingConfig) -> str:
    near, far = cfg.least, cfg.most
    return f"""
    marks as (select trace, pos from chunks where {boundary("fp", near)}),
    lens as (select trace, count(*) as n from chunks group by trace),
    cutting(trace, seg, st, en) as (
        select trace, cast(0 as bigint), cast(0 as bigint), cast(0 as bigint) from lens
        union all
        select c.trace, c.seg + 1, c.en + 1, least(max(l.n), coalesce(min(m.pos), c.en + {far}))
        from cutting c join lens l on l.trace = c.trace left join marks m on m.trace = c.trace and m.pos between c.en + {near} and c.en + {far - 1}
        where c.en < l.n group by c.trace, c.seg, c.en),
    segs as (select row_number() over (order by trace, seg) as seg_id, trace, seg, st, en, en - st + 1 as seg_size from cutting where seg > 0),
    members as (select s.seg_id, s.trace, c.pos - s.st as i, s.seg_size, c.fp from segs s join chunks c on c.trace = s.trace and c.pos between s.st and s.en)"""


def features(cfg: RoutingConfig) -> str:
    f = cfg.features
    short = f"select seg_id, i as fea_pos, fp as fea from members where seg_size <= {f}"
    long = f"from members where seg_size > {f}"
    if cfg.feature == "finesse":
        body = f"select seg_id, least(i // (seg_size // {f}), {f - 1}) as fea_pos, min(fp) as fea {long} group by all union all {short}"
    elif cfg.feature == "mink":
        body = f"select * from (select seg_id, row_number() over (partition by seg_id order by fp, i) - 1 as fea_pos, fp as fea {long}) where fea_pos < {f} union all {short}"
    elif cfg.feature == "first":
        body = "select seg_id, cast(0 as bigint) as fea_pos, fp as fea from members where i = 0"
    elif cfg.feature == "ntrans":
        one = [
            f"select seg_id, cast({j} as bigint) as fea_pos, arg_max(fp, (cast({little_endian('fp', 6)} as hugeint) * {MULTIPLIERS[j] % SPAN} + {OFFSETS[j] % SPAN}) % {SPAN} * 100000 - i) as fea {long} group by seg_id"
            for j in range(f)
        ]
        body = " union all ".join([*one, short])
    else:
        mark = f"case when i > 0 and {boundary('fp', max(cfg.segment // f, 1))} then 1 else 0 end"
        body = f"""
            select seg_id, case when n <= {f} then part else r end as fea_pos, fea from (
                select *, count(*) over (partition by seg_id) as n, row_number() over (partition by seg_id order by fea, part) - 1 as r from (
                    select seg_id, part, min(fp) as fea from (
                        select seg_id, fp, cast(least(sum({mark}) over (partition by seg_id order by i), {cfg.least - 1}) as bigint) as part {long}) group by all))
            where n <= {f} or r < {f} union all {short}"""
    return f"features as ({body})"


def base(stream: str, cfg: RoutingConfig, backups: int = 1) -> str:
    """WITH clause up to `features`; select from it."""
    return f"with recursive {chunks(stream, backups)}, {segments(cfg)}, {features(cfg)}"


def stateless(cfg: RoutingConfig) -> str:
    return f"decisions as (select seg_id, cast({byte('fp', 0)} % {cfg.nodes} as integer) as node from members where i = 0)"


def routing(cfg: RoutingConfig) -> str:
    """Decisions by recursion over segments; every step looks back at all earlier ones."""
    n, first = cfg.nodes, "cast(0 as integer)"
    head = "cast('0x' || substr(fps[1], 1, 2) as integer)"
    packs = f"""
    packs as materialized (select seg_id, list(fp order by i) as fps from members group by seg_id),
    feas as materialized (select seg_id, list(fea order by fea_pos) as fea from features group by seg_id),
    steps as materialized (select p.seg_id, fps, fea, {head} % {n} as home from packs p join feas using (seg_id)),
    flat as materialized (select seg_id, unnest(fps) as fp from packs),
    fine as materialized (select seg_id, fea_pos, fea from features)"""
    stored = "(select x.node, count(distinct f.fp) as st from flat f join (select unnest(range(1, len(r.asg) + 1)) as s, unnest(r.asg) as node) x on x.s = f.seg_id group by x.node)"
    if cfg.policy == "stateless_skew":
        pick = f"""
            select z.id as node, 0 as hit from (
                select k.id, coalesce(s.st, 0) as st, sum(coalesce(s.st, 0)) over () as total from (select cast(unnest(range(0, {n})) as integer) as id) k left join {stored} s on s.node = k.id) z
            order by case when z.total = 0 or z.st * {n} / z.total < {cfg.skew} then 0 else 1 end, (z.id - t.home + {n}) % {n} limit 1"""
    else:
        hits = """(select x.node, count(*) as hit from fine q join (
                select distinct f.fea, x.node from fine f join (select unnest(range(1, len(r.asg) + 1)) as s, unnest(r.asg) as node) x on x.s = f.seg_id) x on x.fea = q.fea
            where q.seg_id = len(r.asg) + 1 group by x.node)"""
        if cfg.policy == "sigma":
            ids = f"(select node as id, min(fea_pos) as o from (select {byte('fea', 5)} % {n} as node, fea_pos from fine where seg_id = len(r.asg) + 1) group by node)"
        else:
            ids = f"(select unnest(range(0, {n})) as id, unnest(range(0, {n})) as o)"
        pick = f"""
            select cast(z.id as integer) as node, z.hit from (
                select *, st / (nullif(sum(st) over (), 0) / count(*) over ()) as ld from (
                    select k.id, k.o, coalesce(h.hit, 0) as hit, coalesce(s.st, 0) as st from {ids} k left join {hits} h on h.node = k.id left join {stored} s on s.node = k.id)) z
            order by (z.hit = len(t.fea)) desc,
                case when z.hit = len(t.fea) then 0 when z.hit > 0 and z.ld < {cfg.skew} then (case when z.ld > 1 then z.hit / z.ld else z.hit end) else 0 end desc,
                case when z.hit = len(t.fea) or (z.hit > 0 and z.ld < {cfg.skew}) then 0 else z.st end, z.o limit 1"""
    return f"""{packs},
    walk(asg, hits) as (
        select cast([] as integer[]), cast([] as bigint[])
        union all
        select list_append(r.asg, b.node), list_append(r.hits, cast(b.hit as bigint)) from walk r join steps t on t.seg_id = len(r.asg) + 1 cross join lateral ({pick}) b),
    whole as (select asg, hits from walk order by len(asg) desc limit 1),
    decisions as (select cast(unnest(range(1, len(asg) + 1)) as bigint) as seg_id, unnest(asg) as node, unnest(hits) as hit from whole)"""


def node_report(cfg: RoutingConfig) -> str:
    head = 12 + 6 * cfg.features
    index = "select cast(null as integer) as node, 0 as fea_tab_size where false" if cfg.policy.startswith("stateless") else "select node, count(distinct fea) as fea_tab_size from features join decisions using (seg_id) group by node"
    return f"""nodes as (
        select node, logic_block, phy_block, fea_tab_size, fp_connec, fp_connec * {head} + logic_block * 6 as segment_volume, fp_connec * 16 + (logic_block - phy_block) * 6 as re_segment_volume from (
            select n.node, coalesce(logic_block, 0) as logic_block, coalesce(phy_block, 0) as phy_block, cast(coalesce(fea_tab_size, 0) as bigint) as fea_tab_size, coalesce(fp_connec, 0) as fp_connec
            from (select cast(unnest(range(0, {cfg.nodes})) as integer) as node) n
            left join (select node, count(*) as logic_block, count(distinct fp) as phy_block from members join decisions using (seg_id) group by node) b using (node)
            left join (select node, count(*) as fp_connec from decisions group by node) c using (node) left join ({index}) x using (node)))"""


def cluster_report(cfg: RoutingConfig) -> str:
    return f"""select logic_block, phy_block, fea_tab_size, fp_connec, segment_volume, re_segment_volume, max_storage,
        round(logic_block / phy_block, 6) as dedup_ratio, round(max_storage * {cfg.nodes} / phy_block, 6) as data_skew,
        round((logic_block / phy_block) / (max_storage * {cfg.nodes} / phy_block), 6) as effective_ratio,
        segment_volume // 1048576 as segment_mb, re_segment_volume // 1048576 as re_segment_mb from (
        select cast(sum(logic_block) as bigint) as logic_block, cast(sum(phy_block) as bigint) as phy_block, cast(sum(fea_tab_size) as bigint) as fea_tab_size, cast(sum(fp_connec) as bigint) as fp_connec,
        cast(sum(segment_volume) as bigint) as segment_volume, cast(sum(re_segment_volume) as bigint) as re_segment_volume, cast(max(phy_block) as bigint) as max_storage from nodes)"""

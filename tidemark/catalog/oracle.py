"""SQL counterparts of the registered queries, for an independent engine over the same tables.

Written from the definitions, not from the Spark plans: ranks instead of cuts, sorted
windows instead of ranges.
"""

from __future__ import annotations

from ..functions.columns import TOWARD_DEFAULT, TOWARD_REPAYING
from ..operators.drift import KEY_FEATURES
from ..operators.features import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from .queries import CANDIDATES, ROUND_CUTS, SCORE_WEIGHTS, SEVERITIES, STREAM_REFERENCE_END, STREAM_SHIFT, STREAM_THRESHOLD

_LOANS = """
li as (
  select l_orderkey, count(*) n_lines, round(avg(l_discount)*100, 6) dti, avg(l_quantity) q,
         max(case when l_returnflag='R' then 1 else 0 end) d
  from lineitem group by l_orderkey),
o as (
  select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) rn from orders),
loans as (
  select o.o_orderkey as id, strftime(o.o_orderdate,'%b-%Y') as issue_d,
    greatest(c_acctbal, 0.0) as revenue, li.dti as dti_n, o_totalprice as loan_amnt, 300 + 11*li.q as fico_n,
    case when rn > 1 then 1 else 0 end as experience_c,
    case when n_lines is null then 'NI' when n_lines = 1 then '< 1 year'
         when n_lines >= 10 then '10+ years' else concat(cast(n_lines as varchar), ' years') end as emp_length,
    o_orderpriority as purpose, c_mktsegment as home_ownership_n, n_name as addr_state,
    concat(lpad(cast(o_custkey % 1000 as varchar), 3, '0'), 'xx') as zip_code,
    cast(coalesce(li.d, 0) as tinyint) as "Default",
    case when o_orderkey % 5 = 0 then null else c_name end as title, doc.text as "desc",
    cast(date_trunc('month', o_orderdate) as date) as issue_date
  from o join customer on o_custkey = c_custkey
         join nation on c_nationkey = n_nationkey
         left join li on li.l_orderkey = o.o_orderkey
         left join documents doc on doc.doc_id = o.o_orderkey)"""

_EMP = """case when trim(emp_length) in ('NI','n/a','NA','') or emp_length is null then null
       when starts_with(trim(emp_length), '<') then 0.0
       when starts_with(trim(emp_length), '10+') then 10.0
       else try_cast(nullif(regexp_extract(emp_length, '[0-9]+'), '') as double) end"""

_FEATS = (
    _LOANS
    + f""",
feats as (
  select id, revenue, dti_n, loan_amnt,
    case when revenue = 0 then null else loan_amnt / revenue end as loan_to_income,
    fico_n, cast(experience_c as double) as experience_c,
    cast({_EMP} as double) as emp_length_years,
    cast(regexp_matches(coalesce("desc", ''), '\\S') as tinyint) as has_desc,
    cast(length(coalesce("desc", '')) as integer) as desc_len,
    cast(regexp_matches(coalesce(title, ''), '\\S') as tinyint) as has_title,
    cast(length(coalesce(title, '')) as integer) as title_len,
    {', '.join(f"coalesce({c}, '__NA__') as {c}" for c in CATEGORICAL_FEATURES)},
    "Default", issue_date,
    case when issue_date <= date '1998-12-31' then 'train'
         when issue_date <= date '1999-12-31' then 'valid' else 'test' end as split
  from loans)"""
)


def _score(a: float, b: float, c: float) -> str:
    return f"round(1 / (1 + exp(-(({a}) + ({b}) * coalesce(emp_length_years, 0) + ({c}) * (coalesce(fico_n, 600) - 600)))), 6)"


_SCORED = (
    _FEATS
    + f""",
scored as (select id, split, {_score(*SCORE_WEIGHTS)} as score, "Default" as y from feats)"""
)


def _stress(fico: str = "-60.0", dti: str = "1.6", income: str = "0.6") -> str:
    """Select list that replaces the stressed columns of ``feats``."""
    revenue = f"revenue * cast({income} as double)"
    return (
        f"* replace (fico_n + cast({fico} as double) as fico_n, dti_n * cast({dti} as double) as dti_n, "
        f"{revenue} as revenue, case when {revenue} = 0 then null else loan_amnt / ({revenue}) end as loan_to_income)"
    )


def _long_numeric(source: str, extra: str = "") -> str:
    parts = [f"select {extra}'{c}' as feature, cast({c} as double) as x from {source}" for c in NUMERIC_FEATURES]
    return f"select * from ({' union all '.join(parts)}) where x is not null"


def _long_levels(source: str, extra: str = "") -> str:
    parts = [f"select {extra}'{c}' as feature, coalesce({c}, '__NA__') as level from {source}" for c in CATEGORICAL_FEATURES]
    return " union all ".join(parts)


_PROBS = "[" + ", ".join(f"{i / 10}" for i in range(11)) + "]"
_TERM = "(greatest(c, 1e-6) - greatest(r, 1e-6)) * ln(greatest(c, 1e-6) / greatest(r, 1e-6))"


def _psi_ctes(ref: str, cur: str) -> str:
    """CTEs psi_num(feature, psi) and psi_cat(feature, psi) of two feature relations."""
    return f"""
ref_num as ({_long_numeric(ref)}),
cur_num as ({_long_numeric(cur)}),
deciles as (select feature, list_sort(list_distinct(quantile_cont(x, {_PROBS}))) as q, count(*) as n from ref_num group by feature),
edges as (select feature, q[2:len(q)-1] as e from deciles where n >= 10 and len(q) >= 3),
ref_bins as (select feature, len(list_filter(e, lambda v: x >= v)) as b, count(*) as n from ref_num join edges using (feature) group by all),
cur_bins as (select feature, len(list_filter(e, lambda v: x >= v)) as b, count(*) as n from cur_num join edges using (feature) group by all),
num_cells as (
  select feature, coalesce(r.n, 0) / (select sum(n) from ref_bins z where z.feature = feature_) as r,
         coalesce(c.n, 0) / (select sum(n) from cur_bins z where z.feature = feature_) as c
  from (select feature, b, feature as feature_ from ref_bins union select feature, b, feature from cur_bins)
  left join ref_bins r using (feature, b) left join cur_bins c using (feature, b)),
psi_num as (
  select f.feature, coalesce(sum({_TERM}), 0.0) as psi
  from (select unnest([{', '.join(f"'{c}'" for c in NUMERIC_FEATURES)}]) as feature) f
  left join num_cells using (feature) group by f.feature),
ref_levels as (select feature, level, count(*) / (select count(*) from {ref}) as p from ({_long_levels(ref)}) group by all),
cur_levels as (select feature, level, count(*) / (select count(*) from {cur}) as p from ({_long_levels(cur)}) group by all),
cat_cells as (
  select feature, coalesce(r.p, 0) as r, coalesce(c.p, 0) as c
  from ref_levels r full join cur_levels c using (feature, level)),
psi_cat as (select feature, sum({_TERM}) as psi from cat_cells group by feature)"""


_TRAIN_TEST = _FEATS + """,
ref as (select * from feats where split = 'train'),
cur as (select * from feats where split = 'test'),"""
_TRAIN_STRESSED = _FEATS + f""",
ref as (select * from feats where split = 'train'),
cur as (select {_stress()} from feats where split = 'test'),"""

_PREDICTION_PSI = """
pq as (select list_sort(list_distinct(quantile_cont(score, {probs}))) as q from ref_scores),
pe as (select q[2:len(q)-1] as e from pq),
pr as (select len(list_filter(e, lambda v: score >= v)) as b, count(*) as n from ref_scores, pe group by all),
pc as (select len(list_filter(e, lambda v: score >= v)) as b, count(*) as n from cur_scores, pe group by all),
pcells as (
  select coalesce(pr.n, 0) / (select sum(n) from pr) as r, coalesce(pc.n, 0) / (select sum(n) from pc) as c
  from pr full join pc using (b)),
ppsi as (select sum({term}) as psi from pcells)""".replace("{probs}", _PROBS).replace("{term}", _TERM)


def _metric_ctes(source: str, by: str = "") -> str:
    """CTE m: the metrics of ``source`` (score, y), by the columns of ``by``."""
    part = f"partition by {by} " if by else ""
    keys = f"{by}, " if by else ""
    return f"""
pts as (select {keys}score, sum(y) as pos, sum(1 - y) as neg, sum((score - y) * (score - y)) as sq from {source} group by {keys}score),
run as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over ({part}) as p, sum(neg) over ({part}) as n
        from pts window w as ({part}order by score desc rows unbounded preceding)),
m as (select {keys}sum(neg * (tp - pos / 2)) / (max(p) * max(n)) as roc_auc,
        sum(pos * tp / (tp + fp)) / max(p) as pr_auc, greatest(0.0, max(tp / p - fp / n)) as ks,
        sum(sq) / (max(p) + max(n)) as brier, max(p) / (max(p) + max(n)) as base_rate,
        cast(max(p) + max(n) as bigint) as n
      from run {f'group by {by}' if by else ''})"""


_TEST_SCORES = _SCORED + ",\nts as (select score, y from scored where split = 'test'),"
_COHORT = """select {by} as cohort, count(*) as n, round(avg(cast("Default" as double)), 9) as default_rate
from loans group by 1 {having} order by 3 desc, 1 {limit}"""



def _with(ctes: str, select: str) -> str:
    return f"with {ctes.strip().rstrip(',')}\n{select.strip()}"


def _encode(split: str, out_of_fold: bool) -> str:
    """Target encoding of one split, fitted on train."""
    ctes = _FEATS + """,
tr as (select *, cast('0x' || substr(md5('42|' || cast(id as varchar)), 1, 8) as bigint) % 5 as fold, "Default" as y
       from feats where split = 'train')"""
    picks = []
    joins = []
    for i, c in enumerate(CATEGORICAL_FEATURES):
        level = f"lv{i}"
        if out_of_fold:
            ctes += f""",
a{i} as (select {c} as level, fold, count(*) as n, sum(y) as p from tr group by all),
f{i} as (select fold, count(*) as n, sum(y) as p from tr group by fold),
g{i} as (select a.level, a.fold, (select sum(n) from a{i} z where z.level = a.level) - a.n as n,
           (select sum(p) from a{i} z where z.level = a.level) - a.p as p,
           (select count(*) from tr) - f.n as an, (select sum(y) from tr) - f.p as ap
         from a{i} a join f{i} f using (fold))"""
            joins.append(f"left join {level} on {level}.level = t.{c} and {level}.fold = t.fold")
        else:
            ctes += f""",
g{i} as (select {c} as level, count(*) as n, sum(y) as p, (select count(*) from tr) as an, (select sum(y) from tr) as ap from tr group by all)"""
            joins.append(f"left join {level} on {level}.level = t.{c}")
        fold = "fold, " if out_of_fold else ""
        ctes += f""",
w{i} as (select level, {fold}n, p, ap / an as prior, n * (ap / an) * (1 - ap / an) as spread from g{i}),
{level} as (select level, {fold}case when n = 0 then prior
              else spread / (spread + (p/n) * (1 - p/n)) * (p/n) + (1 - spread / (spread + (p/n) * (1 - p/n))) * prior end as v from w{i})"""
        picks.append(f"round(coalesce({level}.v, (select avg(y) from tr)), 9) as {c}_te")
    source = "tr t" if out_of_fold else f"(select * from feats where split = '{split}') t"
    return _with(ctes, f"select t.id, {', '.join(picks)} from {source} {' '.join(joins)}")


_CDF_CTES = f"""
ref_num as ({_long_numeric('ref')}),
cur_num as ({_long_numeric('cur')}),
vals as (select feature, x, sum(r) as r, sum(c) as c from
          (select feature, x, 1 as r, 0 as c from ref_num union all select feature, x, 0, 1 from cur_num) group by all),
cdf as (select feature, x, sum(r) over w / sum(r) over (partition by feature) as fr,
          sum(c) over w / sum(c) over (partition by feature) as fc, lead(x) over (partition by feature order by x) as nx
        from vals window w as (partition by feature order by x rows unbounded preceding)),
sig as (select feature, greatest(stddev_pop(x), 0.001) as s from ref_num group by feature),
num as (select feature, max(abs(fr - fc)) as ks, coalesce(sum(abs(fr - fc) * (nx - x)), 0) / max(s) as d
        from cdf join sig using (feature) group by feature),
rl as (select feature, level, count(*) / (select count(*) from ref) as p from ({_long_levels('ref')}) group by all),
cl as (select feature, level, count(*) / (select count(*) from cur) as q from ({_long_levels('cur')}) group by all),
pq as (select feature, coalesce(p, 0) as p, coalesce(q, 0) as q from rl full join cl using (feature, level)),
cat as (select feature, sqrt(greatest(0.0, sum(
          case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2)) as d
        from pq group by feature),
dist as (select feature, 'numeric' as kind, 'wasserstein' as method, d as distance, ks from num
         union all select feature, 'categorical', 'jensen_shannon', d, null from cat),
miss as ({' union all '.join(
    f"select '{c}' as feature, (select avg(case when {c} is null then 1.0 else 0.0 end) from ref) as ref_missing, "
    f"(select avg(case when {c} is null then 1.0 else 0.0 end) from cur) as cur_missing"
    for c in (*NUMERIC_FEATURES, *CATEGORICAL_FEATURES))}),
report as (select feature, kind, method, round(distance, 9) as distance, round(ks, 9) as ks, round(ref_missing, 9) as ref_missing,
             round(cur_missing, 9) as cur_missing, distance >= 0.1 as drifted from dist join miss using (feature))"""


def _profile() -> str:
    numbers = " union all ".join(
        f"""select '{c}' as feature, count(*) as rows, count({c}) as n, count(*) - count({c}) as missing, count(distinct {c}) as "distinct",
        min({c})::double as mn, max({c})::double as mx, avg({c}) as mean, stddev_samp({c}) as sd,
        quantile_cont({c}::double, [0.25, 0.5, 0.75]) as q,
        (select struct_pack(k := count(*), v := {c}::double) from ref where {c} is not null group by {c} order by count(*) desc, {c} desc limit 1) as top,
        null::varchar as lvl from ref"""
        for c in NUMERIC_FEATURES
    )
    levels = " union all ".join(
        f"""select '{c}', count(*), count({c}), count(*) - count({c}), count(distinct {c}), null, null, null, null, null,
        (select struct_pack(k := count(*), v := null::double) from ref group by {c} order by count(*) desc, {c} desc limit 1),
        (select {c} from ref group by {c} order by count(*) desc, {c} desc limit 1) from ref"""
        for c in CATEGORICAL_FEATURES
    )
    return _with(
        _FEATS + ", ref as (select * from feats where split = 'train')",
        f"""select feature, rows, n, missing, "distinct", top.k as top_count, lvl as top_level, round(top.v, 4) as top_number,
        round(mn, 4) as "min", round(mx, 4) as "max", round(mean, 4) as mean, round(sd, 4) as std,
        round(q[1], 4) as q25, round(q[2], 4) as q50, round(q[3], 4) as q75 from ({numbers} union all {levels})""",
    )


def _grid() -> str:
    moved = ("fico_n", "dti_n", "revenue", "loan_to_income")
    steps = ", ".join(f"({s}::double)" for s in SEVERITIES)
    long = " union all ".join(f"select severity, '{c}' as feature, {c} as x from stressed" for c in moved)
    ref_long = " union all ".join(f"select '{c}' as feature, {c} as x from ref" for c in moved)
    ctes = _FEATS + f""",
ref as (select * from feats where split = 'train'),
grid as (select * from (values {steps}) t(severity)),
stressed as (select {_stress('-75.0::double * severity', '1 + 0.75::double * severity', '1 - 0.5::double * severity')} from ref, grid),
rn as (select * from ({ref_long}) where x is not null),
cn as (select * from ({long}) where x is not null),
deciles as (select feature, list_sort(list_distinct(quantile_cont(x, {_PROBS}))) as q from rn group by feature),
edges as (select feature, q[2:len(q)-1] as e from deciles where len(q) >= 3),
rb as (select feature, len(list_filter(e, lambda v: x >= v)) as b, count(*) as n from rn join edges using (feature) group by all),
cb as (select severity, feature, len(list_filter(e, lambda v: x >= v)) as b, count(*) as n from cn join edges using (feature) group by all),
rt as (select feature, sum(n) as n from rb group by feature),
ct as (select severity, feature, sum(n) as n from cb group by all),
allcells as (select severity, feature, b from rb, grid union select severity, feature, b from cb),
shares as (select a.severity, a.feature, coalesce(rb.n, 0) / rt.n as r, coalesce(cb.n, 0) / ct.n as c
  from allcells a left join rb on rb.feature = a.feature and rb.b = a.b
  left join cb on cb.severity = a.severity and cb.feature = a.feature and cb.b = a.b
  join rt on rt.feature = a.feature join ct on ct.severity = a.severity and ct.feature = a.feature),
moved as (select severity, feature, sum({_TERM}) as psi from shares group by all)"""
    still = [c for c in (*NUMERIC_FEATURES, *CATEGORICAL_FEATURES) if c not in moved]
    names = ", ".join(f"'{c}'" for c in still)
    return _with(
        ctes,
        f"""select severity, feature, round(psi, 9) as psi from moved
        union all select severity, feature, 0.0 from grid, (select unnest([{names}]) as feature)""",
    )


def _ledger() -> str:
    rivals = " union all ".join(
        f"select {v} as version, {_score(a, b, c)} as score, \"Default\" as y from feats where split = 'test'"
        for v, a, b, c in CANDIDATES
    )
    return _with(
        _FEATS + f", rivals as ({rivals})," + _metric_ctes("rivals", "version") + """,
v as (select version, roc_auc, roc_auc >= 0.67 as ok, max(case when roc_auc >= 0.67 then version end) over () as live, max(version) over () as newest from m)""",
        """select version, case when version = live then 'Production' when ok then 'Archived' else 'None' end as stage,
        round(roc_auc, 9) as test_roc_auc, case when ok then 'true' else 'false' end as promoted,
        version = coalesce(live, newest) as served from v""",
    )


_STREAM = f"""
ev as (select *, strftime(ts, '%Y-%m-%d') as day from events),
rf as (select * from ev where ts < timestamp '{STREAM_REFERENCE_END}'),
cu as (select * from ev where ts >= timestamp '{STREAM_REFERENCE_END}'),
days as (select distinct day from cu),
dq as (select list_sort(list_distinct(quantile_cont(value, {_PROBS}))) as q from rf),
de as (select q[2:len(q)-1] as e from dq),
rc as (select 'value' as feature, cast(len(list_filter(e, lambda v: value >= v)) as varchar) as cell, count(*) as n from rf, de where value is not null group by all
       union all select 'event_type', coalesce(event_type, '__NA__'), count(*) from rf group by all),
cc as (select day, 'value' as feature, cast(len(list_filter(e, lambda v: value >= v)) as varchar) as cell, count(*) as n from cu, de where value is not null group by all
       union all select day, 'event_type', coalesce(event_type, '__NA__'), count(*) from cu group by all),
ac as (select day, feature, cell from rc, days union select day, feature, cell from cc),
sh as (select ac.day, ac.feature, coalesce(rc.n, 0) / (select sum(n) from rc z where z.feature = ac.feature) as r,
         coalesce(cc.n, 0) / (select sum(n) from cc z where z.feature = ac.feature and z.day = ac.day) as c, coalesce(cc.n, 0) as n
       from ac left join rc on rc.feature = ac.feature and rc.cell = ac.cell
       left join cc on cc.day = ac.day and cc.feature = ac.feature and cc.cell = ac.cell)"""


_MOVED_STREAM = _STREAM.replace(
    "from events)",
    f"""from (select * replace (value + case when ts >= timestamp '{STREAM_REFERENCE_END}' and day(ts) % 3 = 0
                                             then {STREAM_SHIFT}::double else 0::double end as value) from events))""",
)

_BAND = "case when {s} < 0.15 then 'Lower risk' when {s} < 0.30 then 'Moderate risk' else 'Higher risk' end"


def _drifted_list() -> str:
    picks = ", ".join(f"case when (select psi from psi_num where feature = '{c}') > 0.2 then '{c}' end" for c in KEY_FEATURES)
    return f"concat_ws(',', {picks})"


_KEY_FIRED = f"(select bool_or(psi > 0.2) from psi_num where feature in ({', '.join(repr(c) for c in KEY_FEATURES)}))"

# Shapley values of the fixed forest by enumerating subsets: in each tree the value of knowing
# nothing (o), the upper input (u), the lower one (l) or both (b), unknown splits by their covers.
_FOREST = (
    _FEATS
    + """,
x as (select id, split, coalesce(fico_n, 600.0) as f, loan_amnt as l, coalesce(dti_n, 5.0) as d from feats),
n as (select count(*)::double as n, count(*) filter (f <= 560)::double as fl,
             count(*) filter (f <= 560 and l <= 150000)::double as fll, count(*) filter (d <= 5)::double as dl,
             count(*) filter (not d <= 5 and f <= 600)::double as drl
      from x where split = 'train'),
shares as (select fl / n as p, fll / fl as q, dl / n as r, drl / (n - dl) as s from n),
v as (
  select id,
    p * (q * 0.7 + (1 - q) * 0.1) + (1 - p) * -0.4 as o1,
    case when f <= 560 then q * 0.7 + (1 - q) * 0.1 else -0.4 end as u1,
    p * (case when l <= 150000 then 0.7 else 0.1 end) + (1 - p) * -0.4 as l1,
    case when f <= 560 then case when l <= 150000 then 0.7 else 0.1 end else -0.4 end as b1,
    r * 0.3 + (1 - r) * (s * -0.2 + (1 - s) * -0.9) as o2,
    case when d <= 5 then 0.3 else s * -0.2 + (1 - s) * -0.9 end as u2,
    r * 0.3 + (1 - r) * (case when f <= 600 then -0.2 else -0.9 end) as l2,
    case when d <= 5 then 0.3 when f <= 600 then -0.2 else -0.9 end as b2
  from x, shares where split = 'test'),
phi as (
  select id, o1 + o2 as base_value, ((u1 - o1) + (b1 - l1)) / 2 + ((l2 - o2) + (b2 - u2)) / 2 as fico_n,
         ((l1 - o1) + (b1 - u1)) / 2 as loan_amnt, ((u2 - o2) + (b2 - l2)) / 2 as dti_n
  from v),
long as (unpivot phi on fico_n, loan_amnt, dti_n into name feature value shap),
ranked as (select *, row_number() over (partition by id order by abs(shap) desc, feature) - 1 as place from long)"""
)

_FILES = (
    "absent customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations region nation"
).split()
_STATUS = {"absent": "missing", "part": "unlisted", "region": "wrong_size", "nation": "wrong_md5"}
_FILE_ROWS = ", ".join(f"('{f}.parquet', '{_STATUS.get(f, 'ok')}')" for f in _FILES)

_ROUND_CUT_ROWS = ", ".join(f"({f}, {c}::double)" for f, cuts in enumerate(ROUND_CUTS.values(), 1) for c in cuts)
_ROUND_NAMES = ", ".join(f"'{c}'" for c in ROUND_CUTS)


def _level(i: int) -> str:
    """The best split of each node of level i: gradients are 0.5 - y, hessians 0.25."""
    return f""",
cand{i} as (
  select node, f, c, side, sum(0.5 - y) as g, 0.25 * count(*) as h,
         sum(0.5 - y) filter (v <= c or v is null and side = 1) as gl, 0.25 * count(*) filter (v <= c or v is null and side = 1) as hl
  from (select node, y, unnest([1, 2, 3]) as f, unnest(x) as v from n{i}) join cuts using (f), (values (0), (1)) as s(side)
  group by node, f, c, side),
gain{i} as (
  select *, gl * gl / (hl + 1.0) + (g - gl) * (g - gl) / (h - hl + 1.0) - g * g / (h + 1.0) as gain from cand{i} where hl >= 5 and h - hl >= 5),
best{i} as (
  select *, row_number() over (order by node) as place
  from (select * from gain{i} where gain > 1e-6 qualify row_number() over (partition by node order by gain desc, f, c, side) = 1))"""


ORACLE: dict[str, str] = {
    "leak_lineage": _with(
        _LOANS + """,
r as (select id, dti_n, round(loan_amnt * "Default" / 2, 2) as recoveries from loans),
n as (select count(*) filter (recoveries is distinct from dti_n) as other, count(*) filter (not recoveries > 0) as gone from r)""",
        """select 'clean' as way, '' as computed_from, '' as selected_by, 0::bigint as n_changed
        union all select 'renamed', 'dti_n <- recoveries', '', other from n
        union all select 'joined', 'dti_n <- recoveries', '', other from n
        union all select 'filtered', '', 'recoveries', gone from n""",
    ),
    "boosting_round": _with(
        _FEATS
        + f""",
cuts(f, c) as (values {_ROUND_CUT_ROWS}),
n0 as (select 0 as node, "Default"::double as y, [{", ".join(ROUND_CUTS)}] as x from feats where split = 'train')"""
        + _level(0)
        + """,
n1 as (
  select case when x[f] <= c or x[f] is null and side = 1 then 1 else 2 end as node, y, x from n0 join best0 using (node))"""
        + _level(1)
        + """,
n2 as (
  select 1 + 2 * place + case when x[f] <= c or x[f] is null and side = 1 then 0 else 1 end as node, y from n1 join best1 using (node)),
every as (
  select node, y from n0 union all select node, y from n1 union all select node, y from n2),
inner_nodes as (select node, f, c, side from best0 union all select node, f, c, side from best1)""",
        f"""select e.node::int as node, [{_ROUND_NAMES}][f] as feature, c as threshold, side = 1 as missing_left,
  case when f is null then round(-0.3 * sum(0.5 - y) / (0.25 * count(*) + 1.0), 9) end as value, round(0.25 * count(*), 6) as cover
from every e left join inner_nodes i on i.node = e.node group by e.node, f, c, side""",
    ),
    "forest_attribution": _with(
        _FOREST,
        f"""select id, round(base_value, 9) as base_value, cast(place as integer) as place, feature, round(shap, 6) as shap,
                  case when shap > 0 then '{TOWARD_DEFAULT}' else '{TOWARD_REPAYING}' end as pushes from ranked where place < 2""",
    ),
    "forest_global": _with(_FOREST, "select feature, round(avg(abs(shap)), 6) as mean_abs_shap from long group by feature"),
    # The largest over all starts of the smallest over all ends of the mean between them.
    "isotonic_scores": _with(
        _SCORED + """,
pt as (select round(score, 2) as s, sum(y)::double as y, count(*)::double as w from scored where split = 'valid' group by 1),
c as (select s, row_number() over (order by s) as k, sum(y) over (order by s) as cy, sum(w) over (order by s) as cw, y, w from pt),
m as (select a.k as i, b.k as j, (b.cy - a.cy + a.y) / (b.cw - a.cw + a.w) as mean from c a join c b on a.k <= b.k),
t as (select c.k, m.i, min(m.mean) as least from c join m on m.i <= c.k and m.j >= c.k group by c.k, m.i)""",
        "select any_value(c.s) as raw_score, round(max(least), 6) as calibrated from t join c on c.k = t.k group by t.k",
    ),
    "manifest_check": f"select file, status from (values {_FILE_ROWS}) as f(file, status)",
    "source_validation": _with(
        _LOANS,
        """select count(*) as n_rows, count(*) filter (where "Default" not in (0, 1) or "Default" is null) as bad_targets,
        cast(0 as bigint) as n_missing, count(*) > 0 as valid from loans""",
    ),
    "csv_round_trip": _with(
        _LOANS,
        """select cast(issue_date as varchar) as issue_date, count(*) as n, cast(sum("Default") as bigint) as n_default,
        round(sum(loan_amnt), 2) as loan_amnt, cast(coalesce(sum(length("desc")), 0) as bigint) as desc_chars, count(title) as titles,
        count(distinct id) as ids from loans group by issue_date""",
    ),
    "base_rate": _with(
        _LOANS,
        """select count(*) as n_rows, cast(sum("Default") as bigint) as n_default,
        cast(count(*) - sum("Default") as bigint) as n_repaid, round(avg("Default"), 9) as base_rate from loans""",
    ),
    "cohort_by_purpose": _with(_LOANS, _COHORT.format(by="purpose", having="", limit="")),
    "cohort_by_home": _with(_LOANS, _COHORT.format(by="home_ownership_n", having="", limit="")),
    "cohort_min_count": _with(_LOANS, _COHORT.format(by="emp_length", having="having count(*) >= 500", limit="")),
    "cohort_top12": _with(
        _LOANS,
        """select cohort, n, round(rate, 9) as default_rate from
        (select zip_code as cohort, count(*) as n, avg("Default") as rate from loans group by 1 order by rate desc, cohort limit 12)""",
    ),
    "yearly_cohort": _with(
        _LOANS,
        """select cast(year(try_strptime(issue_d, '%b-%Y')) as integer) as issue_year, count(*) as n, round(avg("Default"), 9) as default_rate
        from loans where try_strptime(issue_d, '%b-%Y') is not null group by 1 order by 1""",
    ),
    "cohort_report": _with(
        _LOANS + """,
g as (select yr, purpose, home_ownership_n as home, count(*) as n, avg("Default") as rate,
        grouping(yr) as gy, grouping(purpose) as gp, grouping(home) as gh
      from (select *, year(try_strptime(issue_d, '%b-%Y')) as yr from loans) group by grouping sets ((yr), (purpose), (home), ())),
c as (select case when gy = 0 then 'issue_year' when gp = 0 then 'purpose' when gh = 0 then 'home_ownership_n' else 'base_rate' end as view,
        case when gy = 0 then cast(yr as varchar) when gp = 0 then purpose when gh = 0 then home end as cohort, n, rate from g),
r as (select *, row_number() over (partition by view order by rate desc, cohort) as k from c)""",
        """select view, cohort, n, round(rate, 9) as default_rate from r
        where (view <> 'issue_year' or cohort is not null) and (view <> 'purpose' or k <= 12)""",
    ),
    "value_shares": _with(
        _LOANS,
        """select coalesce(title, '__NA__') as level, count(*) as n, round(count(*) / (select count(*) from loans), 12) as share
        from loans group by 1""",
    ),
    "distinct_values": _with(
        _LOANS,
        " union all ".join(
            f"""select '{c}' as "column", count(distinct {c}) as n_distinct from loans"""
            for c in ("id", "issue_d", "purpose", "addr_state", "zip_code", "title", "loan_amnt")
        ),
    ),
    "issue_date_parse": _with(
        _LOANS,
        """select id, cast(cast(try_strptime(issue_d, '%b-%Y') as date) as varchar) as derived, cast(issue_date as varchar) as typed,
        cast(year(try_strptime(issue_d, '%b-%Y')) as integer) as yr from loans""",
    ),
    "emp_length_parse": _with(
        _LOANS, f"select emp_length, cast({_EMP} as double) as years, count(*) as n from loans group by 1, 2"
    ),
    "text_flags": _with(
        _FEATS,
        "select id, cast(has_desc as integer) as has_desc, desc_len, cast(has_title as integer) as has_title, title_len from feats",
    ),
    "safe_ratio": _with(_FEATS, "select id, round(loan_to_income, 6) as loan_to_income from feats"),
    "feature_matrix": _with(
        _FEATS,
        """select * exclude (split) replace (round(dti_n, 8) as dti_n, round(fico_n, 8) as fico_n,
        round(loan_to_income, 6) as loan_to_income, cast(issue_date as varchar) as issue_date) from feats""",
    ),
    "leak_independence": _with(_LOANS, "select count(*) as n_rows, cast(0 as bigint) as n_changed from loans"),
    "scenario_features": _with(
        _FEATS + f", s as (select {_stress()} from feats where split = 'test')",
        """select id, round(fico_n, 6) as fico_n, round(dti_n, 6) as dti_n, round(revenue, 4) as revenue, loan_amnt,
        round(loan_to_income, 5) as loan_to_income from s""",
    ),
    "time_split_summary": _with(
        _FEATS,
        """select split, count(*) as rows, cast(min(issue_date) as varchar) as date_min, cast(max(issue_date) as varchar) as date_max,
        round(avg("Default"), 9) as default_rate from feats group by split""",
    ),
    "split_integrity": _with(
        _FEATS,
        """select count(*) as total, count(*) filter (where split = 'train') as train, count(*) filter (where split = 'valid') as valid,
        count(*) filter (where split = 'test') as test, cast(0 as bigint) as misplaced, count(*) - count(distinct id) as shared_ids from feats""",
    ),
    "stratified_sample": _with(
        _LOANS + """,
r as (select *, row_number() over (partition by "Default", year(issue_date) order by md5(cast(id as varchar)), id) as rn
      from loans where issue_date is not null)""",
        """select id, issue_d, loan_amnt, emp_length, "Default" from r where rn <= 20 order by id""",
    ),
    "exact_sample": _with(
        _FEATS,
        """select id, loan_amnt, purpose from feats where split = 'train' order by md5('42|' || cast(id as varchar)), id limit 500""",
    ),
    "expanded_window_holdout": _with(
        _FEATS + """,
r as (select id, "Default", row_number() over (partition by "Default" order by md5('42|' || cast(id as varchar)), id) as rn,
        count(*) over (partition by "Default") as n from feats where split in ('train', 'valid'))""",
        """select id, "Default", rn <= round(n * 0.15::double) as is_holdout from r""",
    ),
    "psi_numeric": _with(_TRAIN_TEST + _psi_ctes("ref", "cur"), "select feature, round(psi, 9) as psi from psi_num"),
    "psi_categorical": _with(_TRAIN_TEST + _psi_ctes("ref", "cur"), "select feature, round(psi, 9) as psi from psi_cat"),
    "feature_psi": _with(
        _TRAIN_STRESSED + _psi_ctes("ref", "cur"),
        """select feature, 'numeric' as kind, round(psi, 9) as psi from psi_num
        union all select feature, 'categorical', round(psi, 9) from psi_cat""",
    ),
    "prediction_psi": _with(
        _SCORED + """,
ref_scores as (select score from scored where split = 'valid'),
cur_scores as (select score from scored where split = 'test'),""" + _PREDICTION_PSI,
        "select round(psi, 9) as psi from ppsi",
    ),
    "drift_decision": _with(
        _TRAIN_STRESSED + _psi_ctes("ref", "cur") + f""",
ref_scores as (select {_score(*SCORE_WEIGHTS)} as score from feats where split = 'valid'),
cur_scores as (select {_score(*SCORE_WEIGHTS)} as score from cur),""" + _PREDICTION_PSI,
        f"""select {_drifted_list()} as drifted_features, {_KEY_FIRED} as key_drift, round(psi, 9) as prediction_psi, psi > 0.2 as prediction_drift,
        psi > 0.2 or {_KEY_FIRED} as drift_detected, (select count(*) from ref) as n_reference, (select count(*) from cur) as n_current from ppsi""",
    ),
    "drift_decision_baseline": _with(
        _FEATS + ", ref as (select * from feats where split = 'train')," + _psi_ctes("ref", "ref"),
        f"""select {_drifted_list()} as drifted_features, {_KEY_FIRED} as key_drift, {_KEY_FIRED} as drift_detected,
        (select count(*) from ref) as n_reference""",
    ),
    "scenario_grid_psi": _grid(),
    "drift_report": _with(_TRAIN_STRESSED + _CDF_CTES, "select * from report"),
    "table_drift": _with(
        _TRAIN_STRESSED + _CDF_CTES,
        """select count(*) as n_columns, count(*) filter (where drifted) as n_drifted,
        round(count(*) filter (where drifted) / count(*), 9) as drift_share,
        count(*) filter (where drifted) / count(*) >= 0.5 as table_drifted from report""",
    ),
    "column_profile": _profile(),
    "deciles": _with(
        _FEATS + ", ref as (select * from feats where split = 'train')",
        " union all ".join(
            f"""select '{c}' as feature, cast(i as integer) as decile, round(q[i + 1], 6) as value
            from (select quantile_cont({c}, {_PROBS}) as q from ref), (select unnest(range(11)) as i)"""
            for c in ("fico_n", "dti_n", "revenue", "loan_amnt")
        ),
    ),
    "histogram": _with(
        _TRAIN_TEST + _psi_ctes("ref", "cur"),
        """select feature, cast(b as integer) as bin, coalesce(r.n, 0) as ref, coalesce(c.n, 0) as cur
        from ref_bins r full join cur_bins c using (feature, b)""",
    ),
    "roc_auc": _with(_TEST_SCORES + _metric_ctes("ts"), "select round(roc_auc, 9) as roc_auc from m"),
    "average_precision": _with(_TEST_SCORES + _metric_ctes("ts"), "select round(pr_auc, 9) as pr_auc from m"),
    "ks": _with(_TEST_SCORES + _metric_ctes("ts"), "select round(ks, 9) as ks from m"),
    "brier": _with(_TEST_SCORES + _metric_ctes("ts"), "select round(brier, 9) as brier from m"),
    "metrics_by_split": _with(
        _SCORED + "," + _metric_ctes("scored", "split"),
        """select split, round(roc_auc, 9) as roc_auc, round(pr_auc, 9) as pr_auc, round(ks, 9) as ks, round(brier, 9) as brier,
        round(base_rate, 9) as base_rate, n from m""",
    ),
    "reliability_curve": _with(
        _TEST_SCORES + f"""
rq as (select quantile_cont(score, {_PROBS})[2:10] as e from ts),
rb as (select len(list_filter(e, lambda v: score > v)) as bin, score, y from ts, rq)""",
        """select cast(bin as integer) as bin, round(avg(score), 9) as mean_predicted, round(avg(y), 9) as observed_rate, count(*) as n
        from rb group by bin order by bin""",
    ),
    "latency_p95": "select round(quantile_cont(value, 0.95), 9) as p95, quantile_cont(value, 0.95) < 300 as passed from events",
    "quality_gate": _with(
        _TEST_SCORES + _metric_ctes("ts") + """,
x as (select roc_auc, brier, (select avg((score * score - y) * (score * score - y)) from ts) as before,
        (select quantile_cont(value, 0.95) from events) as p95 from m)""",
        """select 'roc_auc>=0.67' as "check", true as blocking, roc_auc >= 0.67 as passed, printf('test ROC-AUC = %.4f', roc_auc) as detail from x
        union all select 'latency_p95<300ms', true, p95 < 300, printf('p95 = %.1f ms', p95) from x
        union all select 'calibration_improves_brier', false, brier <= before + 1e-6, printf('brier %.5f -> %.5f', before, brier) from x""",
    ),
    "target_encode_oof": _encode("train", True),
    "target_encode_new": _encode("test", False),
    "validate_applications": _with(
        _LOANS + """,
a as (select *, case when id % 97 = 0 then -loan_amnt else loan_amnt end as amount from loans),
e as (select id, concat_ws('; ', case when revenue is null then 'revenue: required' end, case when dti_n is null then 'dti_n: required' end,
        case when amount is null then 'loan_amnt: required' end, case when fico_n is null then 'fico_n: required' end,
        case when revenue < 0 then 'revenue: must be >= 0' end, case when amount <= 0 then 'loan_amnt: must be > 0' end) as errors from a)""",
        "select id, errors, errors = '' as accepted from e",
    ),
    "risk_bands": _with(
        _SCORED + ", b as (select score * score as s, y from scored)",
        f"select {_BAND.format(s='s')} as risk_band, count(*) as n, round(avg(s), 9) as mean_score, round(avg(y), 9) as default_rate from b group by 1",
    ),
    "ledger_current": _ledger(),
    "stream_psi": _with(_STREAM, f"select day, feature, round(sum({_TERM}), 9) as psi, cast(sum(n) as bigint) as n from sh group by day, feature"),
    "stream_scores": _with(
        _SCORED + """,
ok as (select id from loans where revenue is not null and revenue >= 0 and dti_n is not null and fico_n is not null
         and loan_amnt is not null and loan_amnt > 0)""",
        f"select id, score, {_BAND.format(s='score')} as risk_band from scored where id in (select id from ok)",
    ),
    "stream_rejects": _with(
        _LOANS + """,
e as (select id, concat_ws('; ', case when revenue is null then 'revenue: required' end, case when dti_n is null then 'dti_n: required' end,
        case when loan_amnt is null then 'loan_amnt: required' end, case when fico_n is null then 'fico_n: required' end,
        case when revenue < 0 then 'revenue: must be >= 0' end, case when loan_amnt <= 0 then 'loan_amnt: must be > 0' end) as errors from loans)""",
        "select id, errors from e where errors <> ''",
    ),
    "stream_alerts": _with(
        _MOVED_STREAM + f", ps as (select day, feature, sum({_TERM}) as psi from sh group by day, feature)",
        f"""select day, string_agg(feature, ',' order by feature) as drifted_features, round(max(psi), 9) as max_psi
        from ps where psi > {STREAM_THRESHOLD} and cast(day as timestamp) + interval 25 hour <= (select max(ts) from cu) group by day""",
    ),
    "flagship": _with(
        _TRAIN_TEST + _psi_ctes("ref", "cur"),
        """select split, count(*) as rows, cast(min(issue_date) as varchar) as date_min, cast(max(issue_date) as varchar) as date_max,
        round(avg("Default"), 9) as default_rate, (select round(psi, 9) from psi_num where feature = 'fico_n') as fico_psi
        from feats group by split""",
    ),
}

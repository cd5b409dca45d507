"""Evaluation metrics, paired statistics, curves and the ledger."""

import re

from pyspark.sql import functions as F

from claimgraph.functions import selection
from claimgraph.operators import analytics as N
from claimgraph.operators import evidence as E
from claimgraph.operators import ledger as L
from claimgraph.operators import metrics as M
from claimgraph.operators import paths as P
from claimgraph.operators import report as D
from claimgraph.operators import retrieval as R
from claimgraph.operators import stats as T
from claimgraph.plans.inference_queries import two_pass_rows
from claimgraph.plans.registry import CHECKS, SHARED, query, share
from claimgraph.plans.stored import citations, found, graph_edges, stored, vectors
from claimgraph.sources import files

_one = lambda name, view: f"select query_id, '{name}' as condition, rank, rank as vtp_rank, assertion_id, validity_claim_type from {view}"
share("v_results", " union all ".join([
    _one("A", "v_cond_a"), _one("B", "v_cond_b"), _one("C", "v_c"), _one("D", "v_cond_d4"),
    "select query_id, 'E', position, pass1_rank, assertion_id, validity_claim_type from v_e_rows"]))
share("v_cells", """select query_id, epistemic_type, condition from v_queries, (values ('A'), ('B'), ('C'), ('D'), ('E')) c(condition)""")
share("v_nb", """with e as (select here, there, edge_id from v_both where type in ('ENTAILS', 'CAUSES', 'TRIGGERS', 'SPECIALIZES')),
    one as (select query_id, there as id, edge_id from v_neutral join e on here = assertion_id)
    select query_id, id as assertion_id from one where id in (select assertion_id from v_fields) union
    select query_id, there from one join e on e.here = id and e.edge_id <> one.edge_id where there in (select assertion_id from v_fields)""")
share("v_vtp", """select query_id, epistemic_type, condition, 'vtp' as metric, coalesce(case epistemic_type
        when 'normative' then avg(case when validity_claim_type = 'normative' then 1.0::double else 0.0::double end)
        when 'constative' then avg(case when validity_claim_type = 'constative' then 1.0::double else 0.0::double end)
        else case when bool_or(validity_claim_type = 'normative') and bool_or(validity_claim_type = 'constative') then 1.0::double else 0.0::double end end, 0) as value
    from v_cells left join (select * from v_results where vtp_rank <= 10) r using (query_id, condition) group by 1, 2, 3""")
share("v_cover", """select query_id, epistemic_type, condition, n, hits, least_k
    from v_cells left join (select query_id, count(*) as n from v_nb group by 1) using (query_id)
    left join (select query_id, condition, count(*) as hits, min(case when i / n >= 0.8::double then rank end) as least_k
        from (select r.query_id, r.condition, r.rank, row_number() over (partition by r.query_id, r.condition order by r.rank) as i
              from v_results r join v_nb using (query_id, assertion_id))
        join (select query_id, count(*) as n from v_nb group by 1) using (query_id) group by 1, 2) using (query_id, condition)""")
share("v_ac", """select query_id, epistemic_type, condition, 'ac' as metric, case when n is not null then coalesce(hits, 0) / n end as value from v_cover""")
share("v_cwe", """select query_id, epistemic_type, condition, 'cwe' as metric, cast(coalesce(least_k, 50) as double) as value from v_cover""")
share("v_clashing", """select distinct x.query_id, x.condition from v_results x join v_edges e on e.src = x.assertion_id and e.type = 'CONTRADICTS'
    join v_results y on y.query_id = x.query_id and y.condition = x.condition and y.assertion_id = e.dst where x.condition in ('D', 'E')""")
share("v_csr", """select c.query_id, epistemic_type, c.condition, 'csr' as metric, case when k.query_id is not null then 1.0::double else 0.0::double end as value
    from v_cells c left join v_clashing k on k.query_id = c.query_id and k.condition = c.condition""")
share("v_metrics", "select * from v_vtp union all select * from v_ac union all select * from v_cwe union all select * from v_csr")


def results(c):
    def build():
        f, edges = found(c), graph_edges(c)
        parts = {"A": R.condition_a(f, c.assertions), "B": R.condition_b(f, c.assertions, edges),
                 "C": R.condition_c(f, c.assertions), "D": R.condition_d(f, c.assertions, edges, citations(c), "v4")}
        out = two_pass_rows(c).select("query_id", F.lit("E").alias("condition"), F.col("position").alias("rank"),
                                      F.col("pass1_rank").alias("vtp_rank"), "assertion_id", "validity_claim_type")
        for name, rows in parts.items():
            out = out.unionByName(rows.select("query_id", F.lit(name).alias("condition"), F.col("rank").cast("bigint").alias("rank"),
                                              F.col("rank").cast("bigint").alias("vtp_rank"), "assertion_id", "validity_claim_type"))
        return out

    return stored(c, "results", build)


def neighborhood(c):
    def build():
        seeds = R.neutral_seeds(found(c)).withColumnRenamed("assertion_id", "node")
        return P.toulmin_neighborhood(seeds, graph_edges(c), c.assertions)

    return stored(c, "neighborhood", build)


def flags(c):
    clashes = None
    for name in ("D", "E"):
        rows = results(c).where(F.col("condition") == name)
        part = (E.graph_contradictions(rows, graph_edges(c)).select("query_id").distinct()
                .select("query_id", F.lit(name).alias("condition"), F.lit(True).alias("conflicts_detected")))
        clashes = part if clashes is None else clashes.unionByName(part)
    return clashes


def metrics(c):
    def build():
        cells = M.grid(c.queries)
        return (M.validity_precision(results(c), cells).unionByName(M.coverage(results(c), neighborhood(c), cells))
                .unionByName(M.structural_conflicts(cells, flags(c))))

    return stored(c, "metrics", build)


_cols = "query_id, epistemic_type, condition, metric, round(value, 9) as value"


def rounded(rows):
    return rows.withColumn("value", F.round("value", 9))


@query("m01_validity_precision", f"select {_cols} from v_vtp")
def validity_precision(c):
    return rounded(M.validity_precision(results(c), M.grid(c.queries)))


@query("m02_precision_over_all", """select query_id, epistemic_type, condition, round(coalesce(avg(case when assertion_id is null then null
        when epistemic_type = 'mixed' or validity_claim_type = epistemic_type then 1 else 0 end), 0), 9) as value
    from v_cells left join v_results using (query_id, condition) group by 1, 2, 3""")
def precision_over_all(c):
    return rounded(M.precision_over_all(results(c), M.grid(c.queries)))


@query("m03_argumentative_completeness", f"select {_cols} from v_ac")
def argumentative_completeness(c):
    return rounded(M.coverage(results(c), neighborhood(c), M.grid(c.queries)).where("metric = 'ac'"))


@query("m04_context_efficiency", f"select {_cols} from v_cwe")
def context_efficiency(c):
    return rounded(M.coverage(results(c), neighborhood(c), M.grid(c.queries)).where("metric = 'cwe'"))


@query("m05_structural_conflicts", f"select {_cols} from v_csr")
def structural_conflicts(c):
    return rounded(M.structural_conflicts(M.grid(c.queries), flags(c)))


@query("m05_passive_conflicts", """select distinct x.query_id, x.condition from v_results x join v_conflicts k on k.source_assertion_id = x.assertion_id
        and relationship_type = 'CONTRADICTS' and review_status <> 'false_positive'
    join v_results y on y.query_id = x.query_id and y.condition = x.condition and y.assertion_id = k.target_assertion_id""")
def passive_conflicts(c):
    return M.passive_conflicts(results(c), c.conflicts, ["query_id", "condition"])


_summary = """select condition, metric, round(avg(value), 9) as mean, round(median(value), 9) as median, count(*) as n
    from v_metrics where value is not null group by 1, 2"""


@query("m06_condition_summary", _summary)
def condition_summary(c):
    return M.summarize(metrics(c))


_pairs = ", ".join(f"('{a}', '{b}')" for a, b in M.PAIRS)
share("v_paired", f"""select x.query_id, x.epistemic_type, x.metric, p.a || '_vs_' || p.b as pair, x.value as baseline, y.value as treatment
    from (values {_pairs}) p(a, b) join v_metrics x on x.condition = p.a
    join v_metrics y on y.condition = p.b and y.query_id = x.query_id and y.metric = x.metric
    where x.value is not null and y.value is not null""")


def paired(c):
    return M.paired(metrics(c))


@query("m07_paired_scores", "select query_id, epistemic_type, metric, pair, round(baseline, 9) as baseline, round(treatment, 9) as treatment from v_paired")
def paired_scores(c):
    return paired(c).withColumns({"baseline": F.round("baseline", 9), "treatment": F.round("treatment", 9)})


@query("m08_cohens_d", """select pair, metric, round(avg(treatment - baseline) / (stddev_samp(treatment - baseline) + 1e-10), 6) as cohens_d
    from v_paired group by 1, 2""")
def cohens_d(c):
    d = T.cohens_d(F.col("treatment") - F.col("baseline"))
    return paired(c).groupBy("pair", "metric").agg(F.round(d, 6).alias("cohens_d"))


share("v_signed", """select pair, metric, count(*) as n, sum(case when d > 0 then r else 0 end) as w_plus, sum(case when d < 0 then r else 0 end) as w_minus
    from (select pair, metric, d, rank() over (partition by pair, metric order by abs(d)) + (count(*) over (partition by pair, metric, abs(d)) - 1) / 2 as r
          from (select pair, metric, treatment - baseline as d from v_paired) where d <> 0) group by 1, 2""")


@query("m09_rank_biserial", """select pair, metric, coalesce(round((w_plus - w_minus) / (n * (n + 1) / 2 + 1e-10), 6), 0) as rank_biserial
    from (select distinct pair, metric from v_paired) left join v_signed using (pair, metric)""")
def rank_biserial(c):
    return T.signed_ranks(paired(c), ["pair", "metric"]).select("pair", "metric", F.round(T.rank_biserial(), 6).alias("rank_biserial"))


# Ways to reach each rank sum, and the normal tail by Simpson's rule on 2,000 intervals.
share("v_ways", """select n, ways from (with recursive dist(n, ways) as (
        select 0, [1.0::double] union all
        select n + 1, list_transform(range(0, (n + 1) * (n + 2) // 2 + 1), lambda s: coalesce(ways[s + 1], 0)
               + case when s > n then coalesce(ways[s - n], 0) else 0 end) from dist where n < 50) select * from dist)""")
share("v_rank_sums", """select pair, metric, n_pairs, coalesce(n, 0) as n, zeros, coalesce(ties, 0) as ties, least(w_plus, w_minus) as smaller
    from (select pair, metric, count(*) as n_pairs, count(*) filter (treatment = baseline) as zeros from v_paired group by 1, 2)
    left join v_signed using (pair, metric)
    left join (select pair, metric, sum(c * c * c - c) as ties from (select pair, metric, abs(treatment - baseline) as size, count(*)::double as c
               from v_paired where treatment <> baseline group by 1, 2, 3) group by 1, 2) using (pair, metric)""")
share("v_wilcoxon", """select pair, metric, n_pairs, case when r.n = 0 then 'nan'::double
        when r.n <= 50 and zeros = 0 and ties = 0 then least(1, 2 * list_sum(ways[1:floor(smaller)::int + 1]) / pow(2, r.n))
        when variance <= 0 then 'nan'::double
        else 1 - 2 / sqrt(pi()) * x / 6000 * list_sum(list_transform(range(0, 2001), lambda i:
             case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end * exp(-pow(x * i / 2000, 2)))) end as p
    from (select *, abs(smaller - n * (n + 1) / 4) / sqrt(nullif(greatest(variance, 0), 0)) / sqrt(2) as x
          from (select *, n * (n + 1) * (2 * n + 1) / 24 - ties / 48 as variance from v_rank_sums)) r left join v_ways w on w.n = r.n""")


@query("m10_wilcoxon", "select pair, metric, round(p, 8) as wilcoxon_p from v_wilcoxon")
def wilcoxon(c):
    rows = T.wilcoxon(T.signed_ranks(paired(c), ["pair", "metric"]), ["pair", "metric"])
    return rows.withColumn("wilcoxon_p", F.round("wilcoxon_p", 8))


def _permille(p):
    at, part = divmod(999 * p, 1000)
    over = f"(l[{at + 1}] * {1000 - part} + l[{at + 2}] * {part})"
    return f"sign({over}) * ((abs({over}) * 2 + n * 1000000) // (n * 2000000)) / 1e6"


@query("m11_bootstrap_ci", f"""with r as (select pair, metric, round((treatment - baseline) * 1e9)::hugeint as d,
        row_number() over (partition by pair, metric order by query_id) as i, count(*) over (partition by pair, metric) as n from v_paired),
    picks as (select pair, metric, draw, n, ('0x' || substr(md5(concat_ws('|', 7, pair, metric, draw, i)), 1, 15))::bigint % n + 1 as i
              from r, (select unnest(range(1000)) as draw)),
    sums as (select pair, metric, draw, any_value(picks.n)::hugeint as n, sum(d)::hugeint as total from picks join r using (pair, metric, i) group by 1, 2, 3),
    lists as (select pair, metric, any_value(n) as n, list_sort(list(total)) as l from sums group by 1, 2)
    select pair, metric, {_permille(25)} as ci_low, {_permille(975)} as ci_high from lists""")
def bootstrap_ci(c):
    return T.bootstrap_ci(paired(c), ["pair", "metric"])


def _tests_sql(source, keys):
    label = "case when abs(d) < 0.2 then 'negligible' when abs(d) < 0.5 then 'small' when abs(d) < 0.8 then 'medium' else 'large' end"
    return f"""select {keys}, n as n_pairs, case when n >= 3 then round(mb, 6) end as mean_baseline, case when n >= 3 then round(mt, 6) end as mean_treatment,
        case when n >= 3 then round(eb, 6) end as median_baseline, case when n >= 3 then round(et, 6) end as median_treatment,
        case when n >= 3 then round(d, 6) end as cohens_d, case when n >= 3 then {label} end as effect_size_label,
        case when n < 3 then 'insufficient data (n<3)' end as error
    from (select {keys}, count(*) as n, avg(baseline) as mb, avg(treatment) as mt, median(baseline) as eb, median(treatment) as et,
                 avg(treatment - baseline) / (stddev_samp(treatment - baseline) + 1e-10) as d from {source} group by {keys})"""


def _tests(pairs, keys):
    rows = T.paired_tests(pairs, keys, with_p=False)
    numbers = ["mean_baseline", "mean_treatment", "median_baseline", "median_treatment", "cohens_d"]
    return rows.select(*keys, "n_pairs", *[F.round(n, 6).alias(n) for n in numbers], "effect_size_label", "error")


@query("m12_paired_tests", _tests_sql("v_paired", "pair, metric"))
def paired_tests(c):
    return _tests(paired(c), ["pair", "metric"])


@query("m13_tests_by_type", _tests_sql("v_paired", "epistemic_type, pair, metric"))
def tests_by_type(c):
    return _tests(paired(c), ["epistemic_type", "pair", "metric"])


share("v_repetition", "select query_id, round(avg(score), 9) as r from v_top_chunks where rank <= 20 group by 1")


@query("m13_tests_by_repetitiveness", _tests_sql("""(select p.*, case when r >= (select median(r) from v_repetition) then 'high' else 'low' end as stratum
    from v_paired p join v_repetition using (query_id))""", "stratum, pair, metric"))
def tests_by_repetitiveness(c):
    return _tests(paired(c).join(strata(c), "query_id"), ["stratum", "pair", "metric"])


def strata(c):
    index = R.repetitiveness(c.queries, vectors(c))
    middle = selection.middle(index, [], "repetitiveness_index").select(selection.median()).scalar()
    return index.select("query_id", F.when(F.col("repetitiveness_index") >= middle, "high").otherwise("low").alias("stratum"))


# The whole bundle by pair, and again with a subgroup written before the pair.
share("v_ci", CHECKS["m11_bootstrap_ci"])
share("v_biserial", CHECKS["m09_rank_biserial"])
share("v_bundle", f"""select pair, metric, n_pairs, mean_baseline, mean_treatment, median_baseline, median_treatment, cohens_d, effect_size_label, error,
        case when n_pairs >= 3 then rank_biserial end as rank_biserial, case when n_pairs >= 3 then round(p, 8) end as wilcoxon_p,
        case when n_pairs >= 3 then ci_low end as ci_low, case when n_pairs >= 3 then ci_high end as ci_high
    from ({_tests_sql('v_paired', 'pair, metric')}) join (select pair, metric, p from v_wilcoxon) using (pair, metric)
    join v_ci using (pair, metric) join v_biserial using (pair, metric)""")
_bundle_views = ["v_signed", "v_rank_sums", "v_wilcoxon", "v_ci", "v_biserial", "v_bundle"]
for _tag, _subgroup, _source in [
        ("type", "epistemic_type", "v_paired"),
        ("strata", "stratum", """(select p.*, case when r >= (select median(r) from v_repetition) then 'high' else 'low' end as stratum
            from v_paired p join v_repetition using (query_id))""")]:
    share(f"v_paired_{_tag}", f"select query_id, metric, {_subgroup} || '|' || pair as pair, baseline, treatment from {_source}")
    for _view in _bundle_views:
        share(f"{_view}_{_tag}", re.sub(rf"\b({'|'.join(['v_paired', *_bundle_views])})\b", rf"\1_{_tag}", SHARED[_view]))


def _bundle(pairs, keys):
    rows = T.paired_tests(pairs, keys, with_ci=True)
    digits = {"mean_baseline": 6, "mean_treatment": 6, "median_baseline": 6, "median_treatment": 6, "cohens_d": 6, "rank_biserial": 6, "wilcoxon_p": 8}
    return rows.withColumns({name: F.round(name, n) for name, n in digits.items()})


def _split_bundle(view, subgroup):
    return f"select split_part(pair, '|', 1) as {subgroup}, split_part(pair, '|', 2) as pair, * exclude (pair) from {view}"


@query("m12_test_bundles", "select * from v_bundle")
def test_bundles(c):
    return stored(c, "test_bundles", lambda: _bundle(paired(c), ["pair", "metric"]))


@query("m13_test_bundles_by_type", _split_bundle("v_bundle_type", "epistemic_type"))
def test_bundles_by_type(c):
    return stored(c, "test_bundles_by_type", lambda: _bundle(paired(c), ["epistemic_type", "pair", "metric"]))


@query("m13_test_bundles_by_repetitiveness", _split_bundle("v_bundle_strata", "stratum"))
def test_bundles_by_repetitiveness(c):
    return stored(c, "test_bundles_by_repetitiveness", lambda: _bundle(paired(c).join(strata(c), "query_id"), ["stratum", "pair", "metric"]))


def verdict_rows(c):
    return T.verdict(T.paired_tests(paired(c), ["pair", "metric"]))


share("v_test_verdicts", """select pair, metric, case when n_pairs < 3 then 'NOT SUPPORTED (insufficient data)'
            when not isnan(p) and p < 0.05 and abs(d) >= 0.5 then 'SUPPORTED'
            when not isnan(p) and p < 0.05 and abs(d) >= 0.2 or not isnan(p) and p < 0.1 then 'PARTIALLY SUPPORTED' else 'NOT SUPPORTED' end as verdict,
        case when n_pairs < 3 then 'none' when d > 0 then 'gain' when d < 0 then 'loss' else 'none' end as direction
    from v_wilcoxon join (select pair, metric, avg(treatment - baseline) / (stddev_samp(treatment - baseline) + 1e-10) as d
                          from v_paired group by 1, 2) using (pair, metric)""")


@query("m14_verdicts", "select pair, metric, verdict, direction from v_test_verdicts")
def verdicts(c):
    return verdict_rows(c).select("pair", "metric", "verdict", "direction")


@query("m15_supported_propositions", """select count(*) filter (starts_with(verdict, 'SUPPORTED')) as supported, count(*) as propositions
    from v_test_verdicts where pair || ' ' || metric in ('A_vs_D vtp', 'A_vs_D ac', 'C_vs_D vtp', 'B_vs_D ac')""")
def supported_propositions(c):
    # The four propositions by pair and metric.
    chosen = F.concat_ws(" ", "pair", "metric").isin("A_vs_D vtp", "A_vs_D ac", "C_vs_D vtp", "B_vs_D ac")
    return T.supported_propositions(verdict_rows(c).where(chosen))


share("v_curve_queries", "select query_id from v_queries where epistemic_type = 'normative'")
share("v_a100", """select query_id, row_number() over (partition by query_id order by f.rank) as rank, g.validity_claim_type
    from v_found f join v_fields g using (assertion_id) where want = 0 and f.rank <= 100 and query_id in (select query_id from v_curve_queries)""")
share("v_c100", """select query_id, assertion_id, row_number() over (partition by query_id order by f.rank) as rank
    from v_found f join v_fields g using (assertion_id) where want = 1 and f.rank <= 100 and query_id in (select query_id from v_curve_queries)""")
share("v_periphery100", """select query_id, assertion_id from (
        select s.query_id, t.name from v_c100 s join v_cites t using (assertion_id)
        left join (select name, count(*) as n from v_citing group by 1) n on n.name = t.name where s.rank <= 5
        qualify row_number() over (partition by s.query_id order by coalesce(n.n, 0) desc, t.name) = 1) join v_reg_best using (name)""")
_proof = "('ENTAILS', 'DEFINES', 'TRIGGERS', 'SPECIALIZES', 'SUPERSEDES')"
share("v_expand100", f"""select query_id, id as assertion_id from (
        select s.query_id, e.dst as id from v_c100 s join v_edges e on e.src = s.assertion_id where s.rank <= 5 and e.type in {_proof} and e.is_truth_preserving
        union select s.query_id, g.dst from v_c100 s join v_edges e on e.src = s.assertion_id join v_edges g on g.src = e.dst and g.edge_id <> e.edge_id
        where s.rank <= 5 and e.type in {_proof} and e.is_truth_preserving and g.type in {_proof} and g.is_truth_preserving)
    where id in (select assertion_id from v_fields) qualify row_number() over (partition by query_id order by id) <= 100""")
share("v_d100", """select query_id, row_number() over (partition by query_id order by f.confidence desc, assertion_id) as rank, f.validity_claim_type
    from (select query_id, assertion_id from v_c100 union select query_id, assertion_id from v_expand100 union select query_id, assertion_id from v_periphery100)
    join v_fields f using (assertion_id) qualify rank <= 100""")
share("v_curve", """with r as (select 'A' as condition, * from v_a100 union all select 'D', * from v_d100),
    k as (select unnest(range(1, 101)) as k),
    v as (select condition, k, query_id, avg(case when validity_claim_type = 'normative' then 1.0::double else 0.0::double end) as p
          from r join k on rank <= k group by 1, 2, 3)
    select condition, k, round(sum(p) / (select count(*) from v_curve_queries), 6) as vtp from v group by 1, 2""")


def curve(c):
    def build():
        chosen = c.queries.where("epistemic_type = 'normative'").select("query_id")
        rows = found(c, 200).where("rank <= 100").join(chosen, "query_id", "left_semi")
        a = R.condition_a(rows, c.assertions, 100).withColumn("condition", F.lit("A"))
        d = R.condition_d(rows, c.assertions, graph_edges(c), citations(c), "v2", 100).withColumn("condition", F.lit("D"))
        cols = ["query_id", "condition", "rank", "validity_claim_type"]
        sums = M.k_curve(a.select(*cols).unionByName(d.select(*cols)))
        return M.curve_means(sums, chosen.agg(F.count("*")).scalar())

    return stored(c, "curve", build)


@query("m16_k_curve", "select condition, k, vtp from v_curve")
def k_curve(c):
    return curve(c)


@query("m19_step_plateau", """select condition, coalesce(min(k) filter (k >= 11 and abs(vtp - before) < 0.005), -1) as plateau_k
    from (select *, lag(vtp) over (partition by condition order by k) as before from v_curve) group by 1""")
def step_plateau(c):
    return M.step_plateau(curve(c)).select("condition", F.coalesce("plateau_k", F.lit(-1)).alias("plateau_k"))


share("v_k_grid", "select q.query_id, k, q.query_id * 1000 + k as key from v_queries q, (values (5), (10), (20), (50), (100)) g(k)")
share("v_k_a", """select key as query_id, k, f.assertion_id, f.confidence, row_number() over (partition by key order by f.confidence desc, f.assertion_id) as rank
    from v_k_grid g join v_top_chunks t on t.query_id = g.query_id and t.rank <= k join v_assertions a using (chunk_id) join v_fields f on f.assertion_id = a.assertion_id""")
share("v_k_b", """with near as (select query_id, there from (select distinct s.query_id, there from v_k_a s join v_both on here = s.assertion_id
            where s.rank <= 10 and there in (select assertion_id from v_fields)) qualify row_number() over (partition by query_id order by there) <= 200),
    fresh as (select n.query_id, n.there from near n left join v_k_a o on o.query_id = n.query_id and o.assertion_id = n.there
        where o.query_id is null qualify row_number() over (partition by n.query_id order by n.there) <= 50)
    select query_id, assertion_id from v_k_a union all select query_id, there from fresh""")


@query("m17_conflict_curve", """with r as (select 'A' as condition, query_id, assertion_id from v_k_a union all select 'B', query_id, assertion_id from v_k_b),
    hits as (select distinct x.condition, x.query_id from r x join v_conflicts c on c.source_assertion_id = x.assertion_id and relationship_type = 'CONTRADICTS'
            and review_status <> 'false_positive' join r y on y.condition = x.condition and y.query_id = x.query_id and y.assertion_id = c.target_assertion_id)
    select c.condition, g.k::bigint as k, round(avg(case when h.query_id is not null then 1.0::double else 0.0::double end), 6) as csr
    from v_k_grid g cross join (values ('A'), ('B')) c(condition) left join hits h on h.condition = c.condition and h.query_id = g.key group by 1, 2""")
def conflict_curve(c):
    return M.conflict_curve(c.queries, vectors(c), c.assertions, graph_edges(c), c.conflicts)


# ---- the nested result document ------------------------------------------------------------------

def _tests_rows_sql(section, view, subgroup):
    group, pair = ("split_part(pair, '|', 1)", "split_part(pair, '|', 2)") if subgroup else ("''", "pair")
    return f"select '{section}', {group}, {pair}, metric, n_pairs, wilcoxon_p, cohens_d from {view}"


share("v_conflict_curve", CHECKS["m17_conflict_curve"])


@query("s13_nested_results", f"""select 'run' as section, '' as subgroup, 'n_queries' as key, '' as metric, (select count(*) from v_queries) as n,
        null::double as first, null::double as second
    union all select 'run', '', 'n_failed', '', count(*), null, null from v_queries where query_id not in (select query_id from v_results)
    union all select 'distribution', '', epistemic_type, '', count(*), null, null from v_queries group by 3
    union all select 'condition', '', condition, metric, n, mean, median from ({_summary})
    union all {_tests_rows_sql('tests', 'v_bundle', False)}
    union all {_tests_rows_sql('type', 'v_bundle_type', True)}
    union all {_tests_rows_sql('repetitiveness', 'v_bundle_strata', True)}
    union all select 'curve', '', condition, 'vtp_normative', k, vtp, null from v_curve
    union all select 'curve', '', condition, 'csr_by_k', k, csr, null from v_conflict_curve""")
def nested_results(c):
    failed = (c.queries.select("query_id").join(results(c).select("query_id"), "query_id", "left_anti")
              .withColumn("error", F.lit("no results")))
    document = D.nested_results(c.queries, failed, M.summarize(metrics(c)), test_bundles(c), test_bundles_by_type(c),
                                test_bundles_by_repetitiveness(c), curve(c), conflict_curve(c))
    path = files.scratch_folder(c.spark)
    files.write_json(document, path)
    return D.flat_results(c.spark.read.schema(document.schema).json(path))


_ks = ", ".join(f"({k})" for k in M.CURVE_KS)
share("v_padded", f"""with n as (select * from v_found where want in (0, 1) and query_id in (select query_id from v_queries where epistemic_type = 'normative')),
    g as (select k, n.* from n, (values {_ks}) k(k) where want = 1 and rank <= k),
    p as (select k, n.* from n, (values {_ks}) k(k) where want = 0 and rank <= 2 * k),
    filled as (select k, query_id, assertion_id, 0 as tier, rank as r from g union all
        select p.k, p.query_id, p.assertion_id, 1, p.rank from p left join g on g.k = p.k and g.query_id = p.query_id and g.assertion_id = p.assertion_id where g.k is null),
    d as (select k, query_id, assertion_id from filled qualify row_number() over (partition by k, query_id order by tier, r) <= k),
    r as (select 'A' as condition, k, query_id, assertion_id from p where rank <= k union all select 'D', k, query_id, assertion_id from d)
    select condition, k::bigint as k, round(avg(v), 4) as vtp from (
        select condition, k, query_id, avg(case when validity_claim_type = 'normative' then 1.0::double else 0.0::double end) as v
        from r join v_assertions using (assertion_id) group by 1, 2, 3) group by 1, 2""")


@query("m18_padded_curve", "select * from v_padded")
def padded_curve(c):
    return M.padded_curve(found(c, 200), c.assertions, c.queries)


@query("m18_curve_summary", """select min(k) filter (condition = 'A' and vtp >= 0.9 * peak) as plateau_k, round(max(peak), 4) as plateau_vtp,
        round(max(vtp) filter (condition = 'D' and k = 100) - max(vtp) filter (condition = 'A' and k = 100), 4) as gap_at_100
    from v_padded, (select max(vtp) as peak from v_padded where condition = 'A')""")
def curve_summary(c):
    return M.curve_summary(M.padded_curve(found(c, 200), c.assertions, c.queries))


@query("m20_rates", """select (select count(*) from v_ac where condition = 'A' and value is not null) as ac_eligible,
        (select count(*) from v_ac where condition = 'A' and value is null) as ac_excluded,
        (select round(avg(value), 6) from v_csr where condition = 'D') as csr_d_rate, (select round(avg(value), 6) from v_csr where condition = 'E') as csr_e_rate,
        (select round(avg(case when k.query_id is not null then 1.0::double else 0.0::double end), 6) from v_queries q left join (
            select distinct x.query_id from v_results x join v_edges e on e.src = x.assertion_id and e.type = 'CONTRADICTS'
            join v_results y on y.query_id = x.query_id and y.condition = 'D' and y.assertion_id = e.dst
            join v_assertions a on a.assertion_id = e.src join v_assertions b on b.assertion_id = e.dst
            where x.condition = 'D' and a.source_document <> b.source_document) k on k.query_id = q.query_id) as cross_source_rate""")
def rates(c):
    across = E.cross_source_contradictions(results(c).where("condition = 'D'"), graph_edges(c), c.assertions)
    return M.rates(metrics(c), across, c.queries)


@query("m21_side_by_side", """with s as (select case when query_id % 2 = 0 then 'first' else 'second' end as corpus, condition, metric, round(avg(value), 9) as mean
        from v_metrics where value is not null group by 1, 2, 3)
    select coalesce(a.condition, b.condition) as condition, coalesce(a.metric, b.metric) as metric, a.mean as first_mean, b.mean as second_mean
    from (select * from s where corpus = 'first') a full outer join (select * from s where corpus = 'second') b on a.condition = b.condition and a.metric = b.metric""")
def side_by_side(c):
    halves = metrics(c).withColumn("corpus", F.when(F.col("query_id") % 2 == 0, "first").otherwise("second"))
    return M.side_by_side(M.summarize(halves, ["corpus", "condition", "metric"]), ("first", "second"))


# ---- seed eligibility ----------------------------------------------------------------------------

share("v_eligible", """with e as (select src, dst from v_edges where type in ('ENTAILS', 'CAUSES', 'SPECIALIZES', 'TRIGGERS', 'INHIBITS', 'REBUTS'))
    select query_id, n.assertion_id, a.source_document, (select count(*) from e where e.src = n.assertion_id) as directed,
           (select count(*) from e where e.src = n.assertion_id) + (select count(*) from e where e.dst = n.assertion_id) as undirected
    from v_neutral n left join v_assertions a on a.assertion_id = n.assertion_id""")


def eligibility(c):
    return N.seed_eligibility(R.neutral_seeds(found(c)), graph_edges(c), c.assertions)


@query("m27_seed_eligibility", """select query_id, assertion_id, source_document, directed, undirected,
    case when directed > 0 then 'eligible' when undirected > 0 then 'direction_failure' else 'true_sparse' end as outcome from v_eligible""")
def seed_eligibility(c):
    return eligibility(c)


@query("m27_eligibility_report", """select count(*) as total_queries, count(*) filter (directed > 0) as eligible_directed, count(*) filter (undirected > 0) as eligible_undirected,
        count(*) filter (source_document is null) as seed_missing, count(*) filter (directed = 0 and undirected > 0) as direction_failures,
        count(*) filter (undirected = 0) as true_sparse, round(count(*) filter (undirected > 0) / count(*) * 100, 1) as corrected_pct from v_eligible""")
def eligibility_report(c):
    return N.eligibility_report(eligibility(c))


@query("m27_failures_by_document", """select case when undirected > 0 then 'direction_failure' else 'true_sparse' end as outcome, source_document, count(*) as seeds
    from v_eligible where directed = 0 group by 1, 2 qualify row_number() over (partition by outcome order by count(*) desc, source_document) <= 10""")
def failures_by_document(c):
    return N.failures_by_document(eligibility(c))


# ---- ledger --------------------------------------------------------------------------------------

share("v_priced", """select *, case model when 'gemini-1.5-flash' then input_tokens / 1000000 * 0.075::double + output_tokens / 1000000 * 0.3::double
        when 'gemini-1.5-pro' then input_tokens / 1000000 * 1.25::double + output_tokens / 1000000 * 5.0::double
        when 'text-embedding-004' then input_tokens / 1000 * 0.000025::double else 0.0::double end as cost from v_costs""")
share("v_totals", """select *, cast(sum(cast(round(cost, 10) as decimal(28, 10))) over (order by ts, record_id rows unbounded preceding) as double) as running_total from v_priced""")


def priced(c):
    return L.with_cost(c.costs, L.prices(c.spark))


@query("l01_call_costs", "select record_id, model, stage, round(cost, 10) as cost, model <> 'unpriced-model' as is_priced from v_priced")
def call_costs(c):
    return priced(c).select("record_id", "model", "stage", F.round("cost", 10).alias("cost"), "is_priced")


@query("l01_unpriced_models", "select model, count(*) as calls from v_priced where model = 'unpriced-model' group by 1")
def unpriced_models(c):
    return L.unpriced_models(priced(c))


@query("l02_running_total", "select record_id, running_total from v_totals")
def running_total(c):
    return L.running_total(priced(c)).select("record_id", "running_total")


@query("l02_ceiling_crossing", """select record_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, running_total from v_totals
    where running_total >= 1.0 order by ts, record_id limit 1""")
def ceiling_crossing(c):
    return L.ceiling_crossing(L.running_total(priced(c)), 1.0).select(
        "record_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "running_total")


@query("l03_cost_by_stage", """select coalesce(stage, 'all') as stage, coalesce(model, 'all') as model, count(*) as calls, cast(sum(input_tokens) as bigint) as input_tokens,
        cast(sum(output_tokens) as bigint) as output_tokens, cast(sum(cast(round(cost, 10) as decimal(28, 10))) as double) as cost
    from v_priced group by rollup (stage, model)""")
def cost_by_stage(c):
    return L.cost_by_stage(priced(c))


@query("l03_resume_total", "select max(running_total) as resume_total from v_totals")
def resume_total(c):
    return L.resume_total(L.running_total(priced(c)))

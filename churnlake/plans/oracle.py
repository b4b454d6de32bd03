"""DuckDB SQL that states independently what each registered query must return."""

from __future__ import annotations

from churnlake import config as c
from churnlake.operators.recommend import RULES
from churnlake.plans.catalog import COEFFICIENTS


def he(x: str, digits: int = 2) -> str:
    """Half-even rounding of the decimal value."""
    return f"CAST(round_even(CAST({x} AS DECIMAL(30,8)), {digits}) AS DOUBLE)"


def total(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(30,8))) AS DOUBLE)"


def mean(x: str) -> str:
    return f"({total(x)} / count({x}))"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def addon(name: str, divisor: int) -> str:
    return (f"CASE WHEN k % 3 = 2 THEN 'No internet service' WHEN floor(k / {divisor}) % 2 = 0 THEN 'Yes' "
            f"ELSE 'No' END AS {name}")


def score(p: str) -> str:
    return f"CAST({he(f'100.0e0 / (1 + exp(({p} - 0.5e0) * -10))', 0)} AS INTEGER)"


def category(p: str) -> str:
    return f"CASE WHEN {p} >= 0.65e0 THEN 'High' WHEN {p} >= 0.35e0 THEN 'Medium' ELSE 'Low' END"


def label(p: str, cut: str = "0.5e0") -> str:
    return f"CASE WHEN {p} >= {cut} THEN 'Churn' ELSE 'No Churn' END"


def segment(p: str) -> str:
    return (f"CASE WHEN {p} >= 0.65e0 AND InactiveDays > 30 THEN 'Inactive' WHEN {p} >= 0.5e0 AND tenure <= 18 "
            f"THEN 'Risky' WHEN MonthlyCharges >= 70 AND {p} < 0.5e0 THEN 'Premium' ELSE 'Loyal' END")


def points(tenure="tenure", charges="MonthlyCharges", inactive="InactiveDays", contract="Contract",
           payment="PaymentMethod") -> str:
    return f"""greatest(5, least(95, 50
        + CASE WHEN {tenure} <= 6 THEN 25 WHEN {tenure} <= 12 THEN 15 WHEN {tenure} <= 24 THEN 5
               WHEN {tenure} <= 48 THEN -10 ELSE -20 END
        + CASE WHEN {charges} >= 80 THEN 15 WHEN {charges} >= 50 THEN 5 WHEN {charges} >= 20 THEN -15 ELSE 0 END
        + CASE WHEN {inactive} >= 60 THEN 30 WHEN {inactive} >= 30 THEN 15 WHEN {inactive} >= 15 THEN 5 ELSE -25 END
        + CASE {contract} WHEN 'Month-to-month' THEN 20 WHEN 'One year' THEN -5 WHEN 'Two year' THEN -35 ELSE 0 END
        + CASE {payment} WHEN 'Electronic check' THEN 10 WHEN 'Mailed check' THEN 5
               WHEN 'Bank transfer (automatic)' THEN -10 WHEN 'Credit card (automatic)' THEN -10 ELSE 0 END
        )) / 100.0e0"""


ADDONS = [("OnlineSecurity", 11), ("OnlineBackup", 13), ("DeviceProtection", 17), ("TechSupport", 3),
          ("StreamingTV", 19), ("StreamingMovies", 23)]

CUST = f"""
newest AS (SELECT max(o_orderdate) AS m FROM orders),
final_order AS (SELECT o_custkey, max(o_orderdate) AS d FROM orders GROUP BY o_custkey),
base AS (SELECT c_custkey AS k, c_nationkey AS nk, c_mktsegment AS seg, 10 + (c_acctbal + 1000) / 100 AS mc,
         coalesce(date_diff('day', d, m), 90) AS dsl
         FROM customer LEFT JOIN final_order ON o_custkey = c_custkey CROSS JOIN newest),
cust0 AS (SELECT k AS customerID,
    CASE WHEN k % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
    CASE WHEN k % 25 < 4 THEN 1 ELSE 0 END AS SeniorCitizen,
    CASE WHEN floor(k / 5) % 2 = 0 THEN 'Yes' ELSE 'No' END AS Partner,
    CASE WHEN k % 10 < 3 THEN 'Yes' ELSE 'No' END AS Dependents,
    CAST(k % 73 AS INTEGER) AS tenure,
    CASE WHEN k % 10 = 9 THEN 'No' ELSE 'Yes' END AS PhoneService,
    CASE WHEN k % 10 = 9 THEN 'No phone service' WHEN floor(k / 7) % 2 = 0 THEN 'Yes' ELSE 'No' END AS MultipleLines,
    CASE k % 3 WHEN 0 THEN 'DSL' WHEN 1 THEN 'Fiber optic' ELSE 'No' END AS InternetService,
    {", ".join(addon(n, d) for n, d in ADDONS)},
    CASE seg WHEN 'MACHINERY' THEN 'One year' WHEN 'FURNITURE' THEN 'Two year' ELSE 'Month-to-month' END AS Contract,
    CASE WHEN floor(k / 4) % 2 = 0 THEN 'Yes' ELSE 'No' END AS PaperlessBilling,
    CASE nk % 4 WHEN 0 THEN 'Electronic check' WHEN 1 THEN 'Mailed check' WHEN 2 THEN 'Bank transfer (automatic)'
         ELSE 'Credit card (automatic)' END AS PaymentMethod,
    mc AS MonthlyCharges,
    CASE WHEN k % 33 = 0 THEN '' ELSE CAST(CAST(floor(mc * (k % 73)) AS BIGINT) AS VARCHAR) END AS TotalCharges,
    CAST(dsl % 91 AS INTEGER) AS InactiveDays,
    CASE floor(k / 6) % 3 WHEN 0 THEN 'Basic' WHEN 1 THEN 'Standard' ELSE 'Premium' END AS SubscriptionType,
    CASE WHEN (CASE WHEN dsl % 91 > 45 THEN 1 ELSE 0 END + CASE WHEN seg IN ('MACHINERY', 'FURNITURE') THEN 0 ELSE 1 END
        + CASE WHEN k % 73 < 24 THEN 1 ELSE 0 END >= 2) <> (k % 10 = 3) THEN 1 ELSE 0 END AS Churn
    FROM base),
cust AS (SELECT * FROM cust0)"""

PRED = f"""
pred AS (SELECT o_orderkey AS prediction_id, o_custkey AS customer_id, o_totalprice / 500000 AS churn_probability,
    {score('o_totalprice / 500000')} AS risk_score, {category('o_totalprice / 500000')} AS prediction_label,
    {label('o_totalprice / 500000')} AS churn_label, o_orderpriority AS model_used, o_orderdate AS created_at
    FROM orders)"""

SCORED = CUST + f""",
scored0 AS (SELECT *, {points()} AS p FROM cust),
scored AS (SELECT *, p AS churn_probability, {label('p')} AS churn_label, {score('p')} AS risk_score,
    {category('p')} AS risk_category, {segment('p')} AS segment FROM scored0)"""

LATEST = PRED + """,
latest1 AS (SELECT * FROM pred QUALIFY row_number() OVER (
    PARTITION BY customer_id ORDER BY created_at DESC, prediction_id DESC) = 1)"""

TIES = CUST + "," + PRED + """,
ties AS (SELECT p.*, MonthlyCharges, Contract, tenure, InactiveDays FROM pred p JOIN cust ON customerID = customer_id
    QUALIFY rank() OVER (PARTITION BY customer_id ORDER BY created_at DESC) = 1)"""

# Number, multiplier, priority and segments of each rule, stated again for the check.
RULE_NUMBERS = [
    (1, 0.15, 1, ["Risky"]), (2, 0.12, 2, ["Risky", "Inactive"]), (3, 0.15, 2, ["Premium", "Risky"]),
    (4, 0.08, 4, ["Risky"]), (5, 0.10, 1, ["Inactive"]), (6, 0.06, 3, ["Inactive", "Risky"]), (7, 0.05, 3, ["Risky"]),
    (8, 0.07, 3, ["Premium"]), (9, 0.06, 4, ["Risky"]), (10, 0.09, 2, ["Loyal", "Risky"]), (11, 0.05, 5, ["Loyal"]),
    (12, 0.08, 4, ["Premium", "Loyal"]),
]
RULE_ROWS = ", ".join(
    f"({n}, {text(RULES[n - 1].name)}, {text(RULES[n - 1].action)}, {text(RULES[n - 1].reason)}, {m}e0, {p}, {s})"
    for n, m, p, s in RULE_NUMBERS)


def fired(source: str, p: str, use_segment: bool = True, name: str = "recs") -> str:
    """CTEs: the rules each customer of ``source`` triggers, ranked, five at most."""
    boosted = "CASE WHEN list_contains(segs, segment) THEN greatest(1, pr - 1) ELSE pr END" if use_segment else "pr"
    return f"""
rules AS (SELECT * FROM (VALUES {RULE_ROWS}) AS t(n, rule_name, action, reason, mult, pr, segs)),
{name}_all AS (SELECT s.*, n, rule_name, action, reason, mult, {boosted} AS priority,
    {he(f"MonthlyCharges * mult * ({p} * 0.5e0 + 0.5e0)")} AS estimated_savings
    FROM {source} s CROSS JOIN rules WHERE {p} >= 0.3e0 AND CASE n
        WHEN 1 THEN tenure <= 6
        WHEN 2 THEN Contract = 'Month-to-month'
        WHEN 3 THEN MonthlyCharges > 70
        WHEN 4 THEN MonthlyCharges > 45 AND MonthlyCharges <= 70
        WHEN 5 THEN InactiveDays > 45
        WHEN 6 THEN InactiveDays BETWEEN 20 AND 45
        WHEN 7 THEN lower(PaymentMethod) LIKE '%electronic check%'
        WHEN 8 THEN InternetService = 'Fiber optic' AND OnlineSecurity = 'No'
        WHEN 9 THEN TechSupport = 'No'
        WHEN 10 THEN SeniorCitizen = 1
        WHEN 11 THEN Partner = 'No' AND tenure >= 12
        ELSE StreamingTV = 'No' AND StreamingMovies = 'No' AND InternetService <> 'No' END),
{name} AS (SELECT *, row_number() OVER (PARTITION BY customerID ORDER BY priority, estimated_savings DESC, n) AS place
    FROM {name}_all QUALIFY place <= 5)"""


RECS = SCORED + "," + fired("scored", "churn_probability")
RECS_PLAIN = SCORED + "," + fired("scored", "churn_probability", False)
TOP = RECS + f""",
best AS (SELECT s.*, coalesce(action, '{c.NO_ACTION}') AS top_action FROM scored s LEFT JOIN
    (SELECT customerID, action FROM recs WHERE place = 1) r USING (customerID)),
money AS (SELECT b.*, coalesce(savings, 0.0e0) AS savings, coalesce(actions, 0) AS actions FROM best b LEFT JOIN (
    SELECT customerID, CAST(sum(CAST(estimated_savings AS DECIMAL(30,2))) AS DOUBLE) AS savings, count(*) AS actions
    FROM recs GROUP BY customerID) USING (customerID))"""

# recommendations at the latest prediction
TABLE = CUST + "," + LATEST + f""",
at_latest AS (SELECT cust.*, churn_probability, created_at, {segment('churn_probability')} AS segment
    FROM cust JOIN latest1 ON customer_id = customerID),""" + fired("at_latest", "churn_probability", name="tab") + """,
rec_table AS (SELECT customerID AS customer_id, rule_name, action AS recommended_action, estimated_savings, priority,
    (customerID + priority) % 3 = 0 AS is_completed, created_at FROM tab)"""

LOSS = he("churn_probability * coalesce(MonthlyCharges, 0.0e0) * 12")
ALERTS = CUST + "," + PRED + f""",
alert0 AS (SELECT p.*, MonthlyCharges, coalesce(InactiveDays, 0) AS inactive FROM pred p LEFT JOIN cust ON customerID = customer_id),
alert AS (SELECT prediction_id, customer_id,
    CASE WHEN churn_probability >= 0.65e0 THEN 'high_risk' ELSE 'medium_risk' END AS alert_type,
    prediction_label AS risk_category, {he('churn_probability', 4)} AS churn_probability,
    'Customer #' || coalesce(CAST(customer_id AS VARCHAR), 'N/A') || ' flagged with '
      || CAST(CAST({he('churn_probability * 100', 1)} AS DECIMAL(5,1)) AS VARCHAR) || '% churn probability. Risk: '
      || prediction_label || '. Inactive: ' || inactive || ' days. Annual revenue at risk: $'
      || format('{{:,}}', CAST({he(LOSS, 0)} AS BIGINT)) || '.' AS message,
    created_at, prediction_id % 10 < 7 AS email_sent
    FROM alert0 WHERE churn_probability >= 0.65e0 OR (churn_probability >= 0.45e0 AND inactive >= 30))"""
ALERT_COLUMNS = "prediction_id, customer_id, alert_type, risk_category, churn_probability, message, created_at"

CALLS = """
calls AS (SELECT event_id AS id, event_type AS path, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
    user_id, value AS duration_ms, ts AS created_at FROM events)"""

USERS = """
users AS (SELECT user_id, 'U' || user_id || CASE WHEN user_id % 20 = 0 THEN '' ELSE '@' END || 't' || (user_id % 3) || '.io' AS email,
    CASE user_id % 3 WHEN 0 THEN 'Admin' WHEN 1 THEN 'viewer' ELSE 'guest' END AS role, 'user ' || user_id AS name,
    min(ts) AS created_at FROM events GROUP BY user_id)"""

# cleaning: what _raw feeds in, cleaned
CLEAN = CUST + f""",
messy AS (SELECT *, CASE WHEN customerID % 50 = 7 THEN NULL ELSE TRY_CAST(TotalCharges AS DOUBLE) END AS tc FROM cust),
clean AS (SELECT customerID, gender, SeniorCitizen, CAST(tenure AS DOUBLE) AS tenure, Contract, PaymentMethod, MonthlyCharges,
    coalesce(tc, (SELECT median(tc) FROM messy)) AS TotalCharges, CAST(InactiveDays AS DOUBLE) AS InactiveDays, Churn FROM messy)"""
CLEAN_ALL = f"WITH {CLEAN} SELECT * FROM clean"

# encoding
WORDS = {
    "MultipleLines": ["No phone service", "Yes"], "InternetService": ["Fiber optic", "No"],
    **{n: ["No internet service", "Yes"] for n, _ in ADDONS}, "Contract": ["One year", "Two year"],
    "PaymentMethod": ["Credit card (automatic)", "Electronic check", "Mailed check"],
    "SubscriptionType": ["Premium", "Standard"],
}
FLAGS = {"gender": "Female", "Partner": "Yes", "Dependents": "Yes", "PhoneService": "Yes", "PaperlessBilling": "Yes"}
FEATURES = (
    [(x, f"({x} - (SELECT avg({x}) FROM ready)) / (SELECT stddev_pop({x}) FROM ready)") for x in c.NUMERIC]
    + [(f"{x}_{v}", f"CASE WHEN {x} = '{v}' THEN 1.0e0 ELSE 0.0e0 END") for x in c.NOMINAL for v in WORDS[x]]
    + [(x, f"CASE WHEN {x} = '{v}' THEN 1.0e0 ELSE 0.0e0 END") for x, v in FLAGS.items()])
READY = CUST + """,
ready AS (SELECT * EXCLUDE (tenure, TotalCharges, InactiveDays), CAST(tenure AS DOUBLE) AS tenure,
    CAST(InactiveDays AS DOUBLE) AS InactiveDays, coalesce(TRY_CAST(TotalCharges AS DOUBLE),
    (SELECT median(TRY_CAST(TotalCharges AS DOUBLE)) FROM cust)) AS TotalCharges FROM cust)"""
LONG = READY + ",\nlong0 AS (SELECT customerID, Churn, unnest([" + ", ".join(
    f"{{'i': {i}, 'feature': {text(n)}, 'k': CAST({COEFFICIENTS[i]} AS DOUBLE), 'x': {x}}}" for i, (n, x) in enumerate(FEATURES)) + """]) AS f FROM ready),
long AS (SELECT customerID, Churn, f.i AS i, f.feature AS feature, f.k AS k, f.x AS x FROM long0),
mu AS (SELECT i, avg(x) AS m FROM long WHERE Churn = 0 GROUP BY i),
part AS (SELECT customerID, i, feature, x, k * (x - m) AS part FROM long JOIN mu USING (i)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY customerID ORDER BY abs(part) DESC, feature) AS place FROM part)"""

# labelled table of unknown shape
LABELLED = CUST + """,
lab AS (SELECT customerID, gender, CASE WHEN customerID % 9 <> 0 THEN tenure END AS tenure, MonthlyCharges,
    CASE WHEN customerID % 8 <> 0 THEN Contract END AS Contract, CASE WHEN customerID % 7 <> 0 THEN PaymentMethod END AS PaymentMethod,
    InactiveDays, Churn FROM cust),
fill AS (SELECT customerID, gender, coalesce(tenure, (SELECT median(tenure) FROM lab)) AS tenure, MonthlyCharges,
    coalesce(Contract, (SELECT Contract FROM lab WHERE Contract IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS Contract,
    coalesce(PaymentMethod, (SELECT PaymentMethod FROM lab WHERE PaymentMethod IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS PaymentMethod,
    InactiveDays, Churn FROM lab)"""


def prepared(feature: str, x: str, column: str) -> str:
    return (f"SELECT {text(feature)} AS feature, count(*) AS rows, CAST(sum({x}) AS DOUBLE) AS total FROM fill "
            f"HAVING (SELECT count(DISTINCT {column}) / count(*) FROM lab) <= 0.95e0")


LAB_NUMBERS = ["customerID", "tenure", "MonthlyCharges", "InactiveDays"]
LAB_WORDS = {"gender": ["Male"], "Contract": WORDS["Contract"], "PaymentMethod": WORDS["PaymentMethod"]}
PREPARED = [prepared(x, x, x) for x in LAB_NUMBERS] + [
    prepared(f"{x}_{v}", f"CASE WHEN {x} = '{v}' THEN 1 ELSE 0 END", x) for x, vs in LAB_WORDS.items() for v in vs]
PREPARED.append("SELECT 'Customer_Churned' AS feature, count(*) AS rows, CAST(sum(Churn) AS DOUBLE) AS total FROM fill")

# incoming records
INCOMING = CUST + """,
inc AS (SELECT customerID AS k, * EXCLUDE (tenure, MonthlyCharges, Contract, PaymentMethod, SubscriptionType, SeniorCitizen, TotalCharges, Partner),
    CASE WHEN customerID % 40 = 3 THEN NULL WHEN customerID % 40 = 4 THEN -5 ELSE tenure END AS tenure,
    CASE WHEN customerID % 41 = 5 THEN 'free' WHEN customerID % 41 = 6 THEN '-3' WHEN customerID % 41 = 7 THEN NULL
         ELSE CAST(MonthlyCharges AS VARCHAR) END AS charges,
    CASE WHEN customerID % 43 = 8 THEN 'Weekly' ELSE Contract END AS Contract,
    CASE WHEN customerID % 47 = 9 THEN NULL ELSE PaymentMethod END AS PaymentMethod,
    CASE WHEN customerID % 5 = 0 THEN 'Standard' ELSE SubscriptionType END AS SubscriptionType, SeniorCitizen,
    CASE WHEN customerID % 53 = 11 THEN 'n/a' ELSE TotalCharges END AS total_text FROM cust),
judged AS (SELECT *, list_filter([
    CASE WHEN tenure IS NULL THEN 'missing tenure' END,
    CASE WHEN charges IS NULL THEN 'missing monthly_charges' END,
    CASE WHEN PaymentMethod IS NULL THEN 'missing payment_method' END,
    CASE WHEN charges IN ('free', '-3') THEN 'monthly_charges must be a non-negative number' END,
    CASE WHEN Contract = 'Weekly' THEN 'contract is not allowed' END,
    CASE WHEN total_text = 'n/a' THEN 'total_charges must be a number' END], lambda x: x IS NOT NULL) AS reasons FROM inc)"""

# model responses
RESPONSES = CUST + "," + PRED + """,
answer AS (SELECT prediction_id, CAST(CAST(churn_probability AS DECIMAL(10,8)) AS DOUBLE) AS raw, prediction_id % 33 <> 0 AS ok,
    prediction_id % 7 = 0 AS named, prediction_id % 11 = 0 AS priced,
    CASE WHEN coalesce(MonthlyCharges, 0) = 0 THEN 50.0e0 ELSE MonthlyCharges END AS m
    FROM pred LEFT JOIN cust ON customerID = customer_id),
a AS (SELECT *, CASE WHEN ok THEN greatest(0.05e0, least(0.95e0, raw)) ELSE 0.5e0 END AS p FROM answer)"""

# evaluation
EVAL = SCORED + """,
ev AS (SELECT Churn AS label, churn_probability AS p, Contract FROM scored)"""
COUNTS = ("count(*) FILTER (p >= 0.5e0 AND label = 1) AS tp, count(*) FILTER (p >= 0.5e0 AND label = 0) AS fp, "
          "count(*) FILTER (p < 0.5e0 AND label = 0) AS tn, count(*) FILTER (p < 0.5e0 AND label = 1) AS fn")


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0e0 ELSE CAST({a} AS DOUBLE) / ({b}) END"


def class_line(name: str, h: str, w: str, m: str) -> str:
    return (f"SELECT '{name}' AS class, {ratio(h, f'{h}+{w}')} AS precision, {ratio(h, f'{h}+{m}')} AS recall, "
            f"{ratio(f'2*{h}', f'2*{h}+{w}+{m}')} AS f1, {h}+{m} AS support FROM counts")


ROC = """
g AS (SELECT Contract, {p4} AS threshold, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg
    FROM ev GROUP BY ALL)""".format(p4=he("p", 4))


def revenue_rows(source: str, savings: str | None) -> str:
    ltv = f"{he(f'MonthlyCharges * 0.65e0 * CAST({ANNUITY!r} AS DOUBLE)')} * churn_probability"
    recover = f"s.savings * 12" if savings else "s.loss * 12 * 0.1e0"
    extra = f", {total(savings)} AS savings" if savings else ""
    return f""", s AS (SELECT count(*) AS n, count(*) FILTER (churn_probability >= 0.65e0) AS hi,
        count(*) FILTER (churn_probability >= 0.35e0 AND churn_probability < 0.65e0) AS me,
        count(*) FILTER (churn_probability < 0.35e0) AS lo, {total('MonthlyCharges')} AS revenue,
        {total('MonthlyCharges * churn_probability')} AS loss,
        {total('CASE WHEN churn_probability >= 0.65e0 THEN MonthlyCharges END')} AS worst, {total(ltv)} AS ltv,
        {mean('churn_probability')} AS mp{extra} FROM {source})
    SELECT n AS total_customers, hi AS high_risk_count, me AS medium_risk_count, lo AS low_risk_count,
        {he('revenue')} AS total_monthly_revenue, {he('loss')} AS expected_monthly_loss,
        {he('loss * 12')} AS expected_annual_loss, {he('coalesce(worst, 0.0e0) * 12')} AS worst_case_annual_loss,
        {he(recover)} AS recoverable_revenue_annual,
        {he(f'greatest(0.0e0, s.loss * 12 - {recover})')} AS net_revenue_at_risk_annual,
        {he('mp', 4)} AS avg_churn_probability, {he('ltv')} AS total_ltv_at_risk FROM s"""


ANNUITY = (1 - 1.01 ** -24) / 0.01
ANNUITY_36 = (1 - 1.01 ** -36) / 0.01

# Scenario name, factor on charges, and overrides, stated again for the check.
SCENARIOS = [
    ("upgrade_to_annual_contract", "NULL", "'One year'", "NULL", "NULL"),
    ("upgrade_to_two_year_contract", "NULL", "'Two year'", "NULL", "NULL"),
    ("switch_to_autopay", "NULL", "NULL", "'Bank transfer (automatic)'", "NULL"),
    ("reduce_charges_10pct", "0.9e0", "NULL", "NULL", "NULL"),
    ("reduce_charges_15pct", "0.85e0", "NULL", "NULL", "NULL"),
    ("add_online_security", "NULL", "NULL", "NULL", "NULL"),
    ("add_tech_support", "NULL", "NULL", "NULL", "NULL"),
    ("reduce_inactivity", "NULL", "NULL", "NULL", "5"),
    ("full_retention_bundle", "NULL", "'One year'", "'Bank transfer (automatic)'", "10"),
]
WHATIF = CUST + ",\nsc(scenario, f, sc_contract, sc_payment, sc_inactive) AS (VALUES " + ", ".join(
    f"('{n}', {f}, {k}, {p}, {i})" for n, f, k, p, i in SCENARIOS) + f"""),
w0 AS (SELECT customerID, scenario, MonthlyCharges AS m, {points()} AS b,
    {points(charges=f"(CASE WHEN f IS NOT NULL THEN {he('MonthlyCharges * f')} ELSE MonthlyCharges END)",
            inactive="coalesce(sc_inactive, InactiveDays)", contract="coalesce(sc_contract, Contract)",
            payment="coalesce(sc_payment, PaymentMethod)")} AS q FROM cust CROSS JOIN sc),
w AS (SELECT *, {he('q - b', 4)} AS delta FROM w0)"""

STATS = f"""stats AS (SELECT count(*) AS total_customers, count(*) FILTER (p >= 0.65e0) AS high_risk,
    count(*) FILTER (p >= 0.35e0 AND p < 0.65e0) AS medium_risk, count(*) FILTER (p < 0.35e0) AS low_risk,
    {he(mean('p'), 4)} AS avg_churn_probability,
    {he("CAST(count(*) FILTER (p >= 0.5e0) AS DOUBLE) / count(*)", 4)} AS churn_rate,
    {he(total('MonthlyCharges'))} AS total_monthly_revenue, {he(total('MonthlyCharges * p'))} AS expected_monthly_loss,
    {he(he(total('MonthlyCharges * p')) + ' * 12')} AS expected_annual_loss FROM scored)"""

LIVE_LOSS = he(f"{total('MonthlyCharges * churn_probability')} * 12")
METRICS = c.PROFILE_METRICS
CLUSTERED = SCORED + """,
feat AS (SELECT *, {count} AS service_count,
    greatest(0.0e0, least(100.0e0, ({count}) * 10 - InactiveDays * 0.5e0)) AS engagement_score FROM scored)""".format(
    count=" + ".join(f"CASE WHEN {x} = 'Yes' THEN 1 ELSE 0 END" for x in c.SERVICES))

PAID = "coalesce(TRY_CAST(TotalCharges AS DOUBLE), 0.0e0)"
HISTORY = "events"


def best_columns(source="best") -> str:
    return ("SELECT customerID, churn_probability, risk_score, risk_category, churn_label, top_action "
            f"FROM {source}")


REC_SELECT = ("SELECT customerID, place, rule_name, action, priority, estimated_savings, mult AS savings_multiplier, "
              "reason AS triggered_by FROM recs")

ORACLES: dict[str, str] = {
    # sources and sinks
    "raw_csv_scan": CLEAN_ALL,
    "scoring_csv_scan": "",
    "training_csv_scan": f"""WITH {CUST} SELECT 'Québec' AS region, Contract, count(*) AS rows, CAST(sum(Churn) AS BIGINT) AS churners,
        max(tenure) AS max_tenure FROM cust GROUP BY Contract""",
    "table_scans": f"""WITH {TABLE}, {ALERTS[len(CUST) + 1 + len(PRED) + 1:]}
        SELECT 'customers' AS table_name, count(*) AS rows FROM customer UNION ALL
        SELECT 'predictions', count(*) FROM orders UNION ALL SELECT 'recommendations', count(*) FROM rec_table UNION ALL
        SELECT 'alerts', count(*) FROM alert UNION ALL SELECT 'api_calls', count(*) FROM events UNION ALL
        SELECT 'activity', count(*) FROM events UNION ALL
        SELECT 'metrics', count(*) FROM (SELECT DISTINCT event_type, date_trunc('hour', ts) FROM events)""",
    "cleaned_sink": CLEAN_ALL,
    "scored_sink": f"WITH {TOP} {best_columns()}",
    "scored_csv_export": f"WITH {TOP} {best_columns()}",
    "append_sink": """SELECT event_type AS path, count(*) AS calls, CAST(count(*) AS DOUBLE) AS points,
        count(DISTINCT date_trunc('hour', ts)) AS hours FROM events GROUP BY event_type""",
    # table maintenance
    "append_predictions": f"""WITH {SCORED}, {PRED} SELECT * FROM pred UNION ALL
        SELECT (SELECT max(prediction_id) FROM pred) + row_number() OVER (ORDER BY customerID), customerID,
        churn_probability, risk_score, risk_category, churn_label, 'scorecard', NULL FROM scored""",
    "replace_recommendations": f"""WITH {RECS}, {(TABLE[len(CUST) + 1:]).replace("rules AS (", "rules2 AS (")}
        SELECT customer_id, rule_name, estimated_savings, priority FROM rec_table
        WHERE customer_id NOT IN (SELECT customerID FROM recs) UNION ALL
        SELECT customerID, rule_name, estimated_savings, priority FROM recs""",
    "update_customers": f"""WITH {CUST}, {LATEST} SELECT customerID,
        CASE WHEN prediction_label <> 'High' THEN 600 ELSE tenure END AS tenure,
        CASE WHEN prediction_label = 'High' THEN 'One year' ELSE Contract END AS Contract, MonthlyCharges, gender,
        CASE WHEN prediction_label IS NOT NULL THEN TIMESTAMP '2024-02-01 00:00:00' END AS updated_at
        FROM cust LEFT JOIN latest1 ON customer_id = customerID""",
    "bucketed_update": f"""WITH {CUST}, {PRED} SELECT customerID, tenure, CASE WHEN customerID IN (SELECT customer_id FROM pred
        WHERE prediction_label = 'High' AND created_at = (SELECT max(created_at) FROM pred)) THEN 'Two year' ELSE Contract END AS Contract,
        MonthlyCharges, gender FROM cust""",
    "bucketed_changes": """SELECT event_id AS history_id, user_id, CASE WHEN event_id % 9 = 0 THEN 'replaced' WHEN event_id % 14 = 0 THEN 'again'
        ELSE event_type END AS entry_type FROM events WHERE event_id % 7 <> 0 OR event_id % 9 = 0 OR event_id % 14 = 0""",
    "update_users": f"""WITH {USERS} SELECT user_id, email, CASE WHEN user_id % 4 = 0 THEN 'admin' ELSE role END AS role, name,
        user_id % 3 <> 0 AS is_active FROM users""",
    "update_alerts": f"""WITH {ALERTS} SELECT prediction_id, customer_id, TRUE AS email_sent, risk_category,
        CASE WHEN prediction_id % 10 >= 7 THEN 'c' || customer_id || '@t.io' END AS email_address,
        CASE WHEN prediction_id % 10 >= 7 THEN 'sent' ELSE 'new' END AS email_status FROM alert""",
    "delete_history": """SELECT event_id AS history_id, user_id, event_type AS entry_type FROM events
        WHERE event_type <> 'error'""",
    "cascade_delete": f"""WITH {TABLE}, {ALERTS[len(CUST) + 1 + len(PRED) + 1:]},
        gone AS (SELECT customerID FROM cust WHERE Churn = 1),
        sized AS (SELECT customer_id, 'predictions' AS table_name FROM pred UNION ALL
        SELECT customer_id, 'alerts' FROM alert UNION ALL SELECT customer_id, 'recommendations' FROM rec_table)
        SELECT customer_id, count(*) AS rows, table_name FROM sized
        WHERE NOT EXISTS (SELECT 1 FROM gone WHERE customerID = customer_id) GROUP BY ALL""",
    "unlink_alerts": f"""WITH {ALERTS} SELECT CASE WHEN o_totalprice / 500000 >= 0.5e0 THEN prediction_id END AS prediction_id,
        customer_id, alert_type, created_at FROM alert JOIN orders ON o_orderkey = prediction_id""",
    "insert_new_users": f"""WITH {USERS} SELECT email, user_id FROM users UNION ALL
        SELECT 'U' || c_custkey || '@t' || (c_custkey % 3) || '.io', c_custkey FROM customer
        WHERE 'U' || c_custkey || '@t' || (c_custkey % 3) || '.io' NOT IN (SELECT email FROM users)""",
    # cleaning and encoding
    "cleaned_customers": CLEAN_ALL,
    "duplicate_report": """SELECT 2 * count(*) AS rows, count(*) AS kept, count(*) AS dropped FROM customer""",
    "binary_encoding": f"""WITH {CUST} SELECT customerID, """ + ", ".join(
        f"CASE WHEN {x} = '{v}' THEN 1 ELSE 0 END AS {x}" for x, v in FLAGS.items()) + " FROM cust",
    "canonical_with_defaults": f"WITH {CUST} SELECT customerID, tenure, MonthlyCharges, Contract, PaymentMethod, InactiveDays, " + ", ".join(
        f"{text(v) if isinstance(v, str) else v} AS {x}" for x, v in c.COLUMN_DEFAULTS.items() if x != "InactiveDays") + " FROM cust",
    "accepted_customers": f"""WITH {INCOMING} SELECT k AS customerID, greatest(tenure, 0) AS tenure,
        {he('CAST(charges AS DOUBLE)', 4)} AS MonthlyCharges,
        CASE WHEN total_text = '' THEN {he('CAST(charges AS DOUBLE)', 4)} * greatest(tenure, 0) ELSE CAST(total_text AS DOUBLE) END AS TotalCharges,
        InactiveDays, SeniorCitizen, Contract, PaymentMethod, SubscriptionType, 'No' AS Partner, InternetService
        FROM judged WHERE len(reasons) = 0""",
    "rejected_customers": f"""WITH {INCOMING} SELECT k AS customerID, array_to_string(reasons, '; ') AS reasons
        FROM judged WHERE len(reasons) > 0""",
    "validated_users": f"""WITH {USERS} SELECT user_id, name, lower(email) AS email,
        CASE role WHEN 'Admin' THEN 'admin' ELSE 'viewer' END AS role,
        CASE WHEN regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') THEN '' ELSE 'invalid email address' END AS reasons FROM users""",
    "encoded_features": f"WITH {READY} SELECT customerID, " + ", ".join(
        f'{he(x, 6)} AS "{n}"' for n, x in FEATURES) + " FROM ready",
    "feature_matrix": f"WITH {LONG} SELECT customerID, i AS position, {he('x', 6)} AS value FROM long",
    "auto_prepared_table": f"WITH {LABELLED} " + " UNION ALL ".join(PREPARED),
    # features
    "customer_features": f"""WITH {CUST} SELECT customerID,
        CASE WHEN tenure > 0 THEN MonthlyCharges / tenure ELSE 0.0e0 END AS charge_per_tenure,
        {" + ".join(f"CASE WHEN {x} = 'Yes' THEN 1 ELSE 0 END" for x in c.SERVICES)} AS service_count,
        CASE WHEN MonthlyCharges > 70 THEN 1 ELSE 0 END AS is_high_value,
        CASE Contract WHEN 'Month-to-month' THEN 2 WHEN 'One year' THEN 1 WHEN 'Two year' THEN 0 ELSE 1 END AS contract_risk_score,
        CASE PaymentMethod WHEN 'Electronic check' THEN 3 WHEN 'Mailed check' THEN 2 WHEN 'Bank transfer (automatic)' THEN 0
            WHEN 'Credit card (automatic)' THEN 0 ELSE 1 END AS payment_risk_score,
        greatest(0.0e0, least(100.0e0, service_count * 10 - InactiveDays * 0.5e0)) AS engagement_score,
        CASE WHEN tenure <= 6 THEN 0 WHEN tenure <= 24 THEN 1 WHEN tenure <= 48 THEN 2 ELSE 3 END AS tenure_band,
        CASE WHEN MonthlyCharges <= 35 THEN 0 WHEN MonthlyCharges <= 65 THEN 1 WHEN MonthlyCharges <= 85 THEN 2 ELSE 3 END AS charge_band,
        CASE WHEN tenure * MonthlyCharges > 0 THEN greatest(0.0e0, least(2.0e0, {PAID} / (tenure * MonthlyCharges))) ELSE 1.0e0 END AS total_charge_ratio,
        CASE WHEN StreamingTV = 'Yes' OR StreamingMovies = 'Yes' THEN 1 ELSE 0 END AS has_streaming,
        CASE WHEN OnlineSecurity = 'Yes' OR TechSupport = 'Yes' THEN 1 ELSE 0 END AS has_security FROM cust""",
    # scoring
    "risk_scores": f"""WITH {PRED} SELECT prediction_id, churn_probability, risk_score, prediction_label, churn_label,
        {label('churn_probability', '0.8e0')} AS strict_label FROM pred""",
    "scorecard": f"WITH {SCORED} SELECT customerID, churn_probability, churn_label, risk_score, risk_category FROM scored",
    "batch_scores": f"WITH {TOP} {best_columns()}",
    "batch_summary": f"""WITH {SCORED} SELECT count(*) AS total, count(*) FILTER (risk_category = 'High') AS high_risk,
        count(*) FILTER (risk_category = 'Medium') AS medium_risk, count(*) FILTER (risk_category = 'Low') AS low_risk,
        {he(mean('churn_probability'), 4)} AS avg_churn_probability FROM scored""",
    "batch_preview": f"""WITH {SCORED} SELECT churn_probability, risk_score, risk_category, churn_label FROM scored
        ORDER BY customerID LIMIT 100""",
    "normalised_responses": f"""WITH {RESPONSES} SELECT row_number() OVER (ORDER BY prediction_id) AS row_number, prediction_id,
        {he('p', 4)} AS churn_probability, CAST({he('p * 100', 0)} AS INTEGER) AS risk_score, {category('p')} AS risk_category,
        CASE WHEN ok THEN {label('p')} ELSE 'Unknown' END AS churn_label,
        CASE WHEN NOT ok THEN 'Unknown' WHEN named THEN 'Premium' WHEN p >= 0.65e0 THEN 'Risky' ELSE 'Loyal' END AS segment,
        CASE WHEN ok THEN 'order ' || prediction_id ELSE 'Could not parse AI response. Please try again.' END AS explanation,
        CASE WHEN ok AND priced THEN 1.5e0 ELSE {he('p * m')} END AS expected_monthly_loss,
        CASE WHEN ok AND priced THEN 18.0e0 ELSE {he('p * m * 12')} END AS expected_annual_loss,
        CASE WHEN ok AND priced THEN 20.25e0 ELSE {he('p * m * 24 * 0.65e0')} END AS ltv_at_risk,
        CASE WHEN ok AND prediction_id % 17 = 0 THEN 'tenure' ELSE '' END AS factors,
        CASE WHEN ok AND prediction_id % 13 = 0 THEN 'Call' ELSE '' END AS actions FROM a""",
    # evaluation
    "evaluation_metrics": f"""WITH {EVAL}, counts AS (SELECT Contract, {COUNTS} FROM ev GROUP BY Contract)
        SELECT Contract, {he(ratio('tp+tn', 'tp+fp+tn+fn').replace('CAST(tp+tn', 'CAST((tp+tn)'), 4)} AS accuracy,
        {he(ratio('tp', 'tp+fp'), 4)} AS precision, {he(ratio('tp', 'tp+fn'), 4)} AS recall,
        {he(ratio('2*tp', '2*tp+fp+fn'), 4)} AS f1, 0.5e0 AS threshold, tn + fp AS support_0, tp + fn AS support_1 FROM counts""",
    "class_report": f"""WITH {EVAL}, counts AS (SELECT {COUNTS} FROM ev),
        l AS ({class_line('0', 'tn', 'fn', 'fp')} UNION ALL {class_line('1', 'tp', 'fp', 'fn')}),
        r AS (SELECT * FROM l UNION ALL
        SELECT 'macro avg', sum(precision) / 2, sum(recall) / 2, sum(f1) / 2, sum(support) FROM l UNION ALL
        SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
        sum(f1 * support) / sum(support), sum(support) FROM l)
        SELECT class, {he('precision', 4)} AS precision, {he('recall', 4)} AS recall, {he('f1', 4)} AS f1,
        CAST(support AS BIGINT) AS support FROM r""",
    "confusion_matrix": f"""WITH {EVAL} SELECT label AS actual, count(*) FILTER (p < 0.5e0) AS predicted_0,
        count(*) FILTER (p >= 0.5e0) AS predicted_1 FROM ev GROUP BY label""",
    "roc_curve": f"""WITH {EVAL}, {ROC}, t AS (SELECT threshold, CAST(sum(pos) AS BIGINT) AS pos, CAST(sum(neg) AS BIGINT) AS neg
        FROM g GROUP BY threshold)
        SELECT threshold, pos, neg,
        {he("CAST(sum(neg) OVER (ORDER BY threshold DESC) AS DOUBLE) / (SELECT sum(neg) FROM t)", 6)} AS fpr,
        {he("CAST(sum(pos) OVER (ORDER BY threshold DESC) AS DOUBLE) / (SELECT sum(pos) FROM t)", 6)} AS tpr FROM t""",
    # chance that a churner outranks a stayer, ties half: the same area by another route
    "roc_auc": f"""WITH {EVAL}, {ROC}, c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY Contract ORDER BY threshold
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
        SELECT Contract, {he("CAST(sum(pos * (below + neg / 2.0e0)) AS DOUBLE) / (sum(pos) * sum(neg))", 6)} AS roc_auc
        FROM c GROUP BY Contract""",
    # explanations
    "row_explanations": f"""WITH {LONG} SELECT customerID, place, feature, {he('x', 6)} AS feature_value, {he('part', 6)} AS shap_value,
        CASE WHEN part > 0 THEN 'positive' ELSE 'negative' END AS impact FROM ranked WHERE place <= 10""",
    "global_importance": f"""WITH {LONG} SELECT feature, {he('avg(abs(part))', 6)} AS importance,
        CASE WHEN avg(part) > 0 THEN 'increases_churn' ELSE 'decreases_churn' END AS direction
        FROM part GROUP BY feature ORDER BY avg(abs(part)) DESC, feature LIMIT 15""",
    "narratives": f"""WITH {LONG}, sc AS (SELECT customerID, {points()} AS p FROM cust),
        top AS (SELECT *, part > 0 AS up, row_number() OVER (PARTITION BY customerID, part > 0 ORDER BY place) AS nth
            FROM ranked WHERE place <= 5),
        n AS (SELECT customerID, count(*) FILTER (up) AS positive, count(*) FILTER (NOT up) AS negative,
            string_agg(feature, ', ' ORDER BY place) FILTER (up AND nth <= 3) AS ups,
            string_agg(feature, ', ' ORDER BY place) FILTER (NOT up AND nth <= 2) AS downs FROM top GROUP BY customerID)
        SELECT customerID, positive, negative, 'This customer has a ' || CAST({he('p * 100', 0)} AS INTEGER) || '% probability of churning. '
            || CASE WHEN ups IS NULL THEN '' ELSE 'The primary drivers are: ' || ups || '. ' END
            || CASE WHEN downs IS NULL THEN '' ELSE 'Protective factors include: ' || downs || '.' END AS explanation_text
        FROM n JOIN sc USING (customerID)""",
    "stored_explanations": f"WITH {LONG} SELECT customerID, feature, {he('part', 6)} AS shap_value FROM ranked WHERE place <= 10",
    # segments
    "cluster_features": f"""WITH {CLUSTERED} SELECT customerID, CAST(tenure AS DOUBLE) AS tenure, MonthlyCharges,
        CAST(InactiveDays AS DOUBLE) AS InactiveDays, churn_probability, CAST(service_count AS DOUBLE) AS service_count,
        engagement_score FROM feat""",
    "segment_profile": f"WITH {CLUSTERED} SELECT segment, count(*) AS count, "
        + ", ".join(f"{he(mean(x))} AS avg_{x}, {he(f'median(CAST({x} AS DOUBLE))')} AS median_{x}" for x in METRICS)
        + f""", count(*) FILTER (churn_label = 'Churn') AS churn_count,
        {he("count(*) * 100.0e0 / (SELECT count(*) FROM feat)", 1)} AS pct_of_total,
        {he("count(*) FILTER (churn_label = 'Churn') * 100.0e0 / count(*)", 1)} AS churn_rate FROM feat GROUP BY segment""",
    "rule_segments": f"""WITH {TIES}, t AS (SELECT *, {segment('churn_probability')} AS segment FROM ties)
        SELECT segment, count(*) AS count, {he(mean('MonthlyCharges'))} AS avg_monthly_charges,
        {he(mean('churn_probability'), 4)} AS avg_churn_probability, {he(mean('tenure'), 1)} AS avg_tenure,
        {he("count(*) * 100.0e0 / (SELECT count(*) FROM ties)", 1)} AS pct_of_total FROM t GROUP BY segment""",
    # recommendations
    "recommendations": f"WITH {RECS} {REC_SELECT}",
    "recommendations_without_segment": f"WITH {RECS_PLAIN} {REC_SELECT}",
    "top_actions": f"WITH {TOP} SELECT customerID, CAST(actions AS INTEGER) AS actions, top_action FROM money",
    "custom_rules": f"""WITH {SCORED}, r(n, rule_name, mult, pr, segs) AS (VALUES (1, 'paperless_push', 0.03e0, 2, []),
        (2, 'long_dsl', 0.2e0, 1, ['Loyal']), (3, 'big_family', 0.11e0, 1, [])),
        f AS (SELECT customerID, n, rule_name, CASE WHEN list_contains(segs, segment) THEN greatest(1, pr - 1) ELSE pr END AS priority,
            {he('MonthlyCharges * mult * (churn_probability * 0.5e0 + 0.5e0)')} AS estimated_savings FROM scored CROSS JOIN r
            WHERE churn_probability >= 0.2e0 AND CASE n WHEN 1 THEN PaperlessBilling = 'No'
            WHEN 2 THEN InternetService = 'DSL' AND tenure > 24 ELSE Dependents = 'Yes' AND Partner = 'Yes' END)
        SELECT customerID, row_number() OVER (PARTITION BY customerID ORDER BY priority, estimated_savings DESC, n) AS place,
            rule_name, priority, estimated_savings FROM f QUALIFY place <= 2""",
    "recommendation_list": f"""WITH {TABLE} SELECT customer_id, rule_name, recommended_action, priority, estimated_savings,
        created_at, MonthlyCharges, Contract FROM rec_table LEFT JOIN cust ON customerID = customer_id""",
    # revenue
    "lifetime_value": f"""WITH {CUST} SELECT customerID, {he(f'MonthlyCharges * 0.65e0 * CAST({ANNUITY!r} AS DOUBLE)')} AS ltv,
        {he(f'MonthlyCharges * 0.65e0 * CAST({ANNUITY_36!r} AS DOUBLE)')} AS ltv_36,
        {he('MonthlyCharges * 0.65e0 * 24', 4)} AS ltv_undiscounted FROM cust""",
    "customer_revenue_risk": f"""WITH {TOP} SELECT customerID, churn_probability, risk_category,
        {he('MonthlyCharges * churn_probability')} AS expected_monthly_loss,
        {he('MonthlyCharges * churn_probability * 12')} AS expected_annual_loss, {he('MonthlyCharges')} AS worst_case_monthly,
        {he(he(f'MonthlyCharges * 0.65e0 * CAST({ANNUITY!r} AS DOUBLE)') + ' * churn_probability')} AS ltv_at_risk,
        {he('savings * 12')} AS recoverable_revenue,
        {he('greatest(0.0e0, MonthlyCharges * churn_probability * 12 - savings * 12)')} AS net_revenue_at_risk,
        {he('savings * 12 / MonthlyCharges')} AS roi_of_intervention, top_action FROM money""",
    "portfolio_risk": f"WITH {TOP}" + revenue_rows("money", "savings"),
    "portfolio_risk_without_actions": f"WITH {SCORED}" + revenue_rows("scored", None),
    "risk_by_segment": f"""WITH {SCORED} SELECT segment, {he(total('MonthlyCharges * churn_probability') + ' * 12')} AS expected_annual_loss,
        {he(mean('churn_probability'), 4)} AS avg_churn_probability FROM scored GROUP BY segment""",
    "savings_per_customer": f"WITH {TOP} SELECT customerID, savings AS estimated_savings FROM money",
    "portfolio_stats": f"WITH {SCORED}, {STATS} SELECT * FROM stats",
    "segment_distribution": f"WITH {SCORED} SELECT segment, count(*) AS customers FROM scored GROUP BY segment",
    "live_annual_loss": f"WITH {TIES} SELECT coalesce({LIVE_LOSS}, 0.0e0) AS expected_annual_revenue_loss FROM ties",
    # scenarios
    "scenario_results": f"""WITH {WHATIF} SELECT customerID, scenario, b AS base_churn_probability, q AS new_churn_probability,
        delta AS delta_probability, {he('-(q - b) / greatest(b, 0.000001e0) * 100', 1)} AS improvement_pct,
        {category('b')} AS base_risk_category, {category('q')} AS new_risk_category, {score('b')} AS base_risk_score,
        {score('q')} AS new_risk_score, {he('m')} AS monthly_charges,
        {he('greatest(0.0e0, -(q - b)) * m')} AS monthly_revenue_saved FROM w""",
    "scenario_totals": f"""WITH {WHATIF}, t AS (SELECT scenario, count(*) AS total_customers, {he(mean('b'), 4)} AS base_avg_churn_probability,
        {he(mean('q'), 4)} AS new_avg_churn_probability, count(*) FILTER (delta < -0.01e0) AS customers_improved,
        count(*) FILTER (delta > 0.01e0) AS customers_worsened, {he(mean('delta'), 4)} AS avg_probability_delta,
        {total('b * m')} * 12 AS x, {total('q * m')} * 12 AS y FROM w GROUP BY scenario)
        SELECT * EXCLUDE (x, y), {he('x')} AS base_expected_annual_loss, {he('y')} AS new_expected_annual_loss,
        {he('greatest(0.0e0, x - y)')} AS annual_savings FROM t""",
    "tenure_sweep": f"""WITH {CUST}, w AS (SELECT v AS value, {points()} AS b, {points(tenure='v')} AS q FROM cust
        CROSS JOIN (VALUES (1), (12), (24), (36), (48), (60)) AS t(v))
        SELECT value, count(*) AS customers, {he(mean('q'), 4)} AS avg_churn_probability,
        {he(mean(he('q - b', 4)), 4)} AS avg_probability_delta FROM w GROUP BY value""",
    # operations
    "latest_prediction": f"WITH {LATEST} SELECT * FROM latest1",
    "latest_predictions_with_ties": f"WITH {TIES} SELECT * FROM ties",
    "high_risk_customers": f"""WITH {CUST}, {LATEST} SELECT customerID, Contract, MonthlyCharges, prediction_label, churn_probability,
        risk_score FROM cust JOIN latest1 ON customer_id = customerID WHERE prediction_label = 'High'""",
    "prediction_history": f"WITH {PRED} SELECT * FROM pred",
    "prediction_list": f"""WITH {CUST}, {PRED} SELECT pred.*, MonthlyCharges, Contract, tenure FROM pred
        LEFT JOIN cust ON customerID = customer_id WHERE prediction_label = 'Medium'""",
    "prediction_page": f"WITH {PRED} SELECT * FROM pred ORDER BY created_at DESC, prediction_id DESC LIMIT 50 OFFSET 100",
    "bucketed_page": f"WITH {PRED} SELECT * FROM pred ORDER BY churn_probability DESC, prediction_id LIMIT 45 OFFSET 495",
    "numbered_predictions": f"""WITH {PRED} SELECT row_number() OVER (ORDER BY created_at DESC, prediction_id DESC) AS row_number,
        prediction_id FROM pred""",
    "page_info": """SELECT count(*) AS total, 3 AS page, 200 AS page_size, greatest(1, CAST(ceil(count(*) / 200) AS BIGINT)) AS pages,
        3 < greatest(1, ceil(count(*) / 200)) AS has_next, TRUE AS has_prev FROM orders""",
    "risk_distribution": f"WITH {LATEST} SELECT prediction_label, count(*) AS customers FROM latest1 GROUP BY 1",
    "short_trend": f"""WITH {PRED} SELECT CAST(created_at AS DATE) AS day, count(*) AS cnt, {mean('churn_probability')} AS avg_prob
        FROM pred WHERE created_at >= (SELECT max(created_at) FROM pred) - INTERVAL 7 DAY GROUP BY 1""",
    "daily_trend": f"""WITH {PRED} SELECT CAST(created_at AS DATE) AS day, count(*) AS total,
        count(*) FILTER (prediction_label = 'High') AS high, count(*) FILTER (prediction_label = 'Medium') AS medium,
        {he(mean('churn_probability'), 4)} AS avg_prob
        FROM pred WHERE created_at >= (SELECT max(created_at) FROM pred) - INTERVAL 7 DAY GROUP BY 1""",
    "top_churn_customers": f"""WITH {TIES} SELECT customer_id, churn_probability, risk_score, prediction_label, MonthlyCharges, Contract,
        tenure FROM ties ORDER BY churn_probability DESC, prediction_id LIMIT 10""",
    "table_totals": """SELECT (SELECT count(*) FROM customer) AS total_customers, (SELECT count(*) FROM orders) AS total_predictions,
        (SELECT count(*) FROM events WHERE CAST(ts AS DATE) = (SELECT CAST(max(ts) AS DATE) FROM events)) AS api_calls_today""",
    "executive_summary": f"""WITH {TIES}, scored0 AS (SELECT *, {points()} AS p FROM cust), scored AS (SELECT * FROM scored0),
        latest1 AS (SELECT * FROM pred QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, prediction_id DESC) = 1),
        {STATS} SELECT total_customers, avg_churn_probability, churn_rate, total_monthly_revenue, expected_monthly_loss, expected_annual_loss,
        (SELECT count(*) FROM orders) AS total_predictions,
        (SELECT count(*) FROM events WHERE CAST(ts AS DATE) = (SELECT CAST(max(ts) AS DATE) FROM events)) AS api_calls_today,
        (SELECT count(*) FROM latest1 WHERE prediction_label = 'High') AS high_risk,
        (SELECT count(*) FROM latest1 WHERE prediction_label = 'Medium') AS medium_risk,
        (SELECT count(*) FROM latest1 WHERE prediction_label = 'Low') AS low_risk,
        (SELECT {LIVE_LOSS} FROM ties) AS expected_annual_revenue_loss FROM stats""",
    "customer_360": f"""WITH {TABLE}, n AS (SELECT customer_id AS cid, count(*) AS actions, string_agg(rule_name, ','
            ORDER BY priority, estimated_savings DESC, rule_name) AS rules FROM rec_table GROUP BY 1)
        SELECT customerID, Contract, tenure, MonthlyCharges, prediction_id, churn_probability, created_at,
        CAST(coalesce(actions, 0) AS INTEGER) AS actions, n.rules FROM cust LEFT JOIN latest1 ON customer_id = customerID
        LEFT JOIN n ON cid = customerID""",
    "history_list": """SELECT event_id AS history_id, user_id, event_type AS entry_type, event_type AS title, ts AS created_at
        FROM events WHERE event_type = 'purchase'""",
    "opened_history": """SELECT event_id AS history_id, user_id, event_type AS entry_type,
        CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k FROM events""",
    "user_by_email": f"WITH {USERS} SELECT user_id, email, name FROM users WHERE lower(email) = lower('u7@T1.io')",
    "user_list": f"WITH {USERS} SELECT user_id, name, email, role, created_at FROM users",
    # monitoring and alerts
    "trailing_totals": f"""SELECT count(*) AS calls, coalesce({total('value')}, 0.0e0) AS total, {he(f"coalesce({mean('value')}, 0.0e0)", 4)} AS mean
        FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 900 SECOND""",
    "trailing_series": f"""WITH s AS (SELECT event_type AS path, date_trunc('second', ts) AS second, count(*) AS n,
            sum(CAST(value AS DECIMAL(30,8))) AS v FROM events GROUP BY ALL),
        t AS (SELECT path, second, CAST(sum(n) OVER w AS BIGINT) AS calls, CAST(sum(v) OVER w AS DOUBLE) AS total FROM s
            WINDOW w AS (PARTITION BY path ORDER BY second RANGE BETWEEN INTERVAL 900 SECOND PRECEDING AND CURRENT ROW))
        SELECT path, second, calls, total, {he('total / calls', 4)} AS mean FROM t""",
    "prediction_counters": f"""WITH {PRED} SELECT count(*) AS total_predictions, count(*) FILTER (prediction_label = 'High') AS high_risk_total,
        count(*) FILTER (prediction_label = 'Medium') AS medium_risk_total, count(*) FILTER (prediction_label = 'Low') AS low_risk_total FROM pred""",
    "latency_by_band": f"""SELECT count(*) AS total_predictions, 0 AS high_risk_total, 0 AS medium_risk_total, count(*) AS low_risk_total,
        {he(mean('CASE WHEN value > 0 THEN value END'), 1)} AS avg_prediction_ms FROM events""",
    "top_endpoints": "SELECT event_type AS path, count(*) AS calls FROM events GROUP BY 1 ORDER BY calls DESC, path LIMIT 8",
    "error_rate": f"""WITH {CALLS} SELECT count(*) AS total_api_calls, count(*) FILTER (status_code >= 500) AS error_count,
        {he('count(*) FILTER (status_code >= 500) * 100.0e0 / greatest(count(*), 1)')} AS error_rate_pct FROM calls""",
    "active_users": "SELECT count(DISTINCT user_id) FILTER (user_id <> 0) AS active_users FROM events",
    "hourly_calls": f"""SELECT date_trunc('hour', ts) AS hour, count(*) AS calls, {he(mean('value'), 1)} AS avg_ms FROM events
        WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY 1""",
    "churn_alerts": f"WITH {ALERTS} SELECT {ALERT_COLUMNS} FROM alert",
    "recent_alerts": f"""WITH {ALERTS} SELECT {ALERT_COLUMNS} FROM alert WHERE risk_category = 'High'
        ORDER BY created_at DESC, prediction_id DESC LIMIT 50""",
    "alert_stats": f"""WITH {ALERTS} SELECT count(*) AS total_alerts,
        count(*) FILTER (CAST(created_at AS DATE) = (SELECT CAST(max(created_at) AS DATE) FROM alert)) AS alerts_today,
        count(*) FILTER (risk_category = 'High') AS high_risk_alerts, count(*) FILTER (email_sent) AS emails_sent,
        max(created_at) AS last_alert_at FROM alert""",
    "monitoring_dashboard": f"""WITH {PRED}, {CALLS}, m AS (SELECT max(created_at) AS t FROM calls),
        recent AS (SELECT * FROM calls, m WHERE created_at >= t - INTERVAL 900 SECOND)
        SELECT count(*) AS total_predictions, count(*) FILTER (prediction_label = 'High') AS high_risk_total,
        count(*) FILTER (prediction_label = 'Medium') AS medium_risk_total, count(*) FILTER (prediction_label = 'Low') AS low_risk_total,
        (SELECT count(*) FROM pred, m WHERE created_at BETWEEN t - INTERVAL 900 SECOND AND t) AS predictions_15min,
        (SELECT count(*) FROM calls) AS total_api_calls, (SELECT count(*) FROM calls WHERE status_code >= 500) AS error_count,
        (SELECT {he('count(*) FILTER (status_code >= 500) * 100.0e0 / greatest(count(*), 1)')} FROM calls) AS error_rate_pct,
        (SELECT count(DISTINCT user_id) FROM calls WHERE user_id <> 0) AS active_users,
        (SELECT count(*) FROM recent) AS api_calls_15min,
        (SELECT {he(he(mean('duration_ms'), 4), 1)} FROM recent) AS avg_latency_ms, 0.0e0 AS avg_prediction_ms,
        (SELECT string_agg(path || ':' || n, ';' ORDER BY n DESC, path) FROM (SELECT path, count(*) AS n FROM calls GROUP BY 1
            ORDER BY n DESC, path LIMIT 8)) AS top_endpoints,
        (SELECT string_agg(concat_ws(':', day, total, high, medium), ';' ORDER BY day) FROM (
            SELECT CAST(created_at AS DATE) AS day, count(*) AS total, count(*) FILTER (prediction_label = 'High') AS high,
            count(*) FILTER (prediction_label = 'Medium') AS medium FROM pred
            WHERE created_at >= (SELECT max(created_at) FROM pred) - INTERVAL 7 DAY GROUP BY 1)) AS prediction_trend,
        (SELECT string_agg(strftime(hour, '%Y%m%d%H') || ':' || n, ';' ORDER BY hour) FROM (
            SELECT date_trunc('hour', created_at) AS hour, count(*) AS n FROM calls, m WHERE created_at >= t - INTERVAL 24 HOUR
            GROUP BY 1)) AS hourly_calls FROM pred""",
    "daily_usage": f"""WITH {TABLE}, a AS (SELECT CAST(ts AS DATE) AS day, count(*) AS api_calls,
            count(DISTINCT user_id) FILTER (user_id <> 0) AS active_users FROM events GROUP BY 1),
        b AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS predictions_generated,
            count(DISTINCT customer_id) FILTER (prediction_label = 'High') AS high_risk_customers FROM pred GROUP BY 1),
        d AS (SELECT CAST(created_at AS DATE) AS day, count(*) FILTER (is_completed) AS retention_actions_taken FROM rec_table GROUP BY 1)
        SELECT day, coalesce(api_calls, 0) AS api_calls, coalesce(active_users, 0) AS active_users,
        coalesce(predictions_generated, 0) AS predictions_generated, coalesce(high_risk_customers, 0) AS high_risk_customers,
        coalesce(retention_actions_taken, 0) AS retention_actions_taken
        FROM a FULL JOIN b USING (day) FULL JOIN d USING (day)""",
    # streams, over all windows
    "stream_call_windows": f"""WITH w AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, count(*) AS calls,
            count(*) FILTER (event_type = 'error') AS errors, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS duration FROM events GROUP BY 1)
        SELECT window_start, window_start + INTERVAL 15 MINUTE AS window_end, calls, errors, duration FROM w""",
    "stream_trailing_windows": """WITH e AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes(o) AS window_start, event_type
            FROM events CROSS JOIN (VALUES (0), (5), (10)) AS t(o))
        SELECT window_start, window_start + INTERVAL 15 MINUTE AS window_end, count(*) AS calls,
        count(*) FILTER (event_type = 'error') AS errors FROM e GROUP BY 1""",
    "stream_metric_points": """WITH w AS (SELECT date_trunc('hour', ts) AS window_start, count(*) AS calls,
            count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)
        SELECT 'api_calls' AS metric_name, CAST(calls AS DOUBLE) AS metric_value, window_start, window_start + INTERVAL 1 HOUR AS window_end FROM w
        UNION ALL SELECT 'api_errors', CAST(errors AS DOUBLE), window_start, window_start + INTERVAL 1 HOUR FROM w""",
    "sketched_quantiles": """SELECT o_orderpriority AS model_used, p AS probability, count(*) AS rows, TRUE AS within_bound
        FROM orders, (VALUES (0.1e0), (0.5e0), (0.9e0)) AS v(p) GROUP BY 1, 2""",
    "stream_daily_users": """SELECT CAST(ts AS DATE) AS day, count(DISTINCT CASE WHEN user_id <> 0 THEN user_id END) AS exact,
        TRUE AS within_bound FROM events GROUP BY 1""",
    # of the two newest days the older one comes last; what lies an hour behind the newest call is late
    "stream_late_rows": """WITH d AS (SELECT CAST(ts AS DATE) AS day, ts, event_type FROM events
            WHERE CAST(ts AS DATE) IN (SELECT DISTINCT CAST(ts AS DATE) AS x FROM events ORDER BY x DESC LIMIT 2)),
        j AS (SELECT *, day < max(day) OVER () AND time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE
            <= max(ts) OVER () - INTERVAL 1 HOUR AS late FROM d)
        SELECT CAST(day AS TIMESTAMP) AS window_start, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors,
            count(*) FILTER (NOT late) AS calls_before, count(*) FILTER (late) AS late FROM j GROUP BY day""",
    "stream_call_log": f"WITH {CALLS} SELECT * FROM calls",
    "stream_alerts": f"WITH {ALERTS} SELECT {ALERT_COLUMNS} FROM alert",
    # scalars and audit
    "masked_emails": f"""WITH {USERS} SELECT user_id, CASE WHEN len(email) - len(replace(email, '@', '')) <> 1 THEN '***'
        ELSE CASE WHEN strpos(email, '@') > 2 THEN left(email, 1) ELSE '' END || '***@' || split_part(email, '@', 2) END AS masked FROM users""",
    "sanitized_texts": r"SELECT conv_id, turn, substr(trim(text, e' \t\n\r\x0b\x0c'), 1, 255) AS clean FROM conversations",
    "data_audit": f"""WITH {CUST}, f AS (SELECT count(*) AS n, count(*) FILTER (tenure < 0) AS bt, count(*) FILTER (MonthlyCharges <= 0) AS bm,
            count(*) FILTER (Churn NOT IN (0, 1)) AS bc, count(*) FILTER (Contract NOT IN ('Month-to-month', 'One year', 'Two year')) AS bk,
            count(DISTINCT customerID) AS ids, max(tenure) AS mt, avg(Churn) AS rate, quantile_cont(MonthlyCharges, 0.99) AS p99,
            count(*) FILTER (tenure IS NULL) AS nt, count(*) FILTER (MonthlyCharges IS NULL) AS nm, count(*) FILTER (Contract IS NULL) AS nc FROM cust)
        SELECT 'required_columns' AS "check", 0.0e0 AS value, TRUE AS passed FROM f UNION ALL
        SELECT 'not_empty', CAST(n AS DOUBLE), n > 0 FROM f UNION ALL
        SELECT 'tenure_non_negative', CAST(bt AS DOUBLE), bt = 0 FROM f UNION ALL SELECT 'charges_positive', CAST(bm AS DOUBLE), bm = 0 FROM f UNION ALL
        SELECT 'target_domain', CAST(bc AS DOUBLE), bc = 0 FROM f UNION ALL SELECT 'contract_domain', CAST(bk AS DOUBLE), bk = 0 FROM f UNION ALL
        SELECT 'p99_charge', p99, p99 < 200 FROM f UNION ALL SELECT 'max_tenure', CAST(mt AS DOUBLE), mt <= 200 FROM f UNION ALL
        SELECT 'churn_rate', rate, rate > 0.05 AND rate < 0.7 FROM f UNION ALL SELECT 'null_tenure', CAST(nt AS DOUBLE), nt = 0 FROM f UNION ALL
        SELECT 'null_MonthlyCharges', CAST(nm AS DOUBLE), nm = 0 FROM f UNION ALL SELECT 'null_Contract', CAST(nc AS DOUBLE), nc = 0 FROM f UNION ALL
        SELECT 'duplicate_rate', CAST(n - ids AS DOUBLE) / n, (n - ids) / n <= 0.02 FROM f""",
}
ORACLES["scoring_csv_scan"] = ORACLES["batch_summary"]

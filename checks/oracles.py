"""DuckDB SQL of the queries, written apart from the Spark code.

The SQL takes the straight way (month spines by generate_series, running sums
over whole customers), so it checks the chunked plans by another route. A query
is put together from the common tables it names.
"""

import re

BANK_TXN = """
select concat('T', cast(c_nationkey as varchar)) company_id, c_custkey customer_id,
 (l_orderkey*10+l_linenumber)*1000000 + l_partkey%1000*1000 + l_suppkey%1000 seq,
 case when l_suppkey=13 and l_partkey%4=0 then 'not-a-date' else strftime(date '2023-01-01' + cast(case when c_custkey%10=0 then l_orderkey%3 when c_custkey%10=1 then l_orderkey%28 else l_orderkey%180 end as integer),'%Y-%m-%d') end date,
 case when (l_orderkey+l_linenumber)%3=0 then (['SALARY DEPOSIT','Payroll credit','Savings deposit','Investment payout','Transfer from J','Loan disbursement','Refund','Dividend'])[l_partkey%8+1] else (['RENT PAYMENT','KPLC prepaid','Uber trip','NAIVAS grocery','Loan payment','Restaurant','ATM withdrawal','Transfer to K','Insurance premium','Mortgage instalment','Fuel','Misc','Water bill','Cinema movie','Carrefour','Cash out'])[l_partkey%16+1] end description,
 cast(case when (l_orderkey+l_linenumber)%3=0 then l_extendedprice*(1+c_custkey%4) else l_extendedprice*(case when l_partkey%37=0 then 10 else 1 end)/(1+(c_custkey%3)*20) end as decimal(18,2)) amount,
 case when l_partkey%97=0 then 'unknown' when (l_orderkey+l_linenumber)%3=0 then 'credit' else 'debit' end type,
 case when c_custkey%7=0 or (c_custkey%5=0 and l_linenumber%2=0) then null else cast(c_acctbal*(c_custkey%30)+l_linenumber*100 as decimal(18,2)) end balance_after,
 c_mktsegment segment
from lineitem join orders on l_orderkey=o_orderkey join customer on o_custkey=c_custkey
"""

MOBILE_TXN = """
select concat('T', cast(c_nationkey as varchar)) company_id, user_id customer_id, event_id seq, strftime(ts,'%Y-%m-%d') date,
 case when user_id%4=3 and event_type in ('click','view') and event_id%5<>0 then 'Airtime' when user_id%4=2 and event_type='error' and event_id%9<>0 then 'Airtime' else case event_type when 'purchase' then 'M-PESA Pay Merchant' when 'click' then 'M-PESA Send Money' when 'view' then 'M-PESA Receive Money' when 'signup' then 'Agent deposit' when 'error' then 'Fuliza Loan Repayment' end end description,
 cast(value*(case when event_type in ('view','signup') then 40 else 1+(user_id%8)*60 end)*(case when event_type='error' and user_id%3=0 then 0.02::double else 1.0::double end) as decimal(18,2)) amount,
 case when event_type in ('view','signup') then 'credit' else 'debit' end type, cast(null as decimal(18,2)) balance_after
from events join customer on user_id=c_custkey
"""

CRB = """
select concat('T', cast(c_nationkey as varchar)) company_id, c_custkey customer_id,
 c_custkey*7%60 credit_history_months, cast(c_custkey*13%104 as double) payment_performance_score,
 coalesce(nullif(c_custkey%7, 6), 0) recent_late_payments,
 cast(c_custkey*17%103 as double) credit_utilization_ratio,
 coalesce(nullif(c_custkey%9, 8), 0) credit_inquiries,
 least(c_custkey%5, 4) num_credit_types, least(c_custkey%4, 3) num_accounts
from customer
"""

TENANT_LOG = """
select concat('T', cast(n_nationkey as varchar)) company_id, s_suppkey "version",
 case when n_nationkey%3=0 then 'KES' when n_nationkey%3=1 then 'UGX' end currency_preference,
 case when s_suppkey%4=1 then 'sw' end language_preference,
 case n_nationkey%5 when 2 then '[{"category":"savings","keywords":["savings","investment"]},{"category":"income","keywords":["salary","payroll","deposit"]},{"category":"loan_repayment","keywords":["loan payment","instalment"]}]'
  when 4 then '{"income":["Salary","dividend"],"housing":["rent","mortgage"],"savings":["deposit"]}' when 0 then 'none yet' end rules,
 case when n_nationkey%5=1 then '{"high_balance_bonus":150,"overdraft_penalty":90,"anomaly_penalty":10}' end bank_w,
 case when n_nationkey%5=1 then '{"long_credit_history_bonus":30,"late_payment_penalty_per_instance":25}' end crb_w,
 case when n_nationkey%5=3 then '{"digital_inclusion_bonus":40,"high_loan_dependency_penalty":70}' end mobile_w,
 case when n_nationkey%5=3 then '{"good_data_completeness_bonus":10,"anomaly_penalty_per_anomaly":5}' end unified_w,
 case when n_nationkey%2=0 then '{"professional":false,"concise":true,"avoid_jargon":true}' end tone,
 case when s_suppkey%3=0 then s_suppkey%40+1 end max_file_size_mb
from supplier join nation on s_nationkey=n_nationkey where n_regionkey<>0
"""

LOG_COLUMNS = (
    "currency_preference", "language_preference", "rules", "bank_w", "crb_w", "mobile_w",
    "unified_w", "tone", "max_file_size_mb",
)

DEFAULT_RULES = [
    ("income", ["salary", "payroll", "deposit"]),
    ("rent", ["rent", "landlord"]),
    ("utilities", ["kplc", "water", "electricity", "utility", "internet"]),
    ("transport", ["fuel", "petrol", "uber", "matatu", "bus"]),
    ("groceries", ["supermarket", "grocery", "naivas", "carrefour"]),
    ("loan_repayment", ["loan payment", "instalment", "repayment"]),
    ("entertainment", ["restaurant", "bar", "club", "movie", "leisure"]),
    ("savings", ["savings deposit", "fixed deposit", "investment"]),
    ("withdrawal", ["atm withdrawal", "cash out"]),
    ("transfer_out", ["transfer to"]),
    ("transfer_in", ["transfer from"]),
]
LISTED_RULES = [
    ("savings", ["savings", "investment"]),
    ("income", ["salary", "payroll", "deposit"]),
    ("loan_repayment", ["loan payment", "instalment"]),
]
OBJECT_RULES = [
    ("income", ["salary", "dividend"]),
    ("housing", ["rent", "mortgage"]),
    ("savings", ["deposit"]),
]


def _case(rules) -> str:
    whens = " ".join(
        "when regexp_matches(lower(description), '{}') then '{}'".format("|".join(words), name)
        for name, words in rules
    )
    return f"(case {whens} else 'Uncategorized' end)"


def _weight(column: str, name: str, default: float) -> str:
    return f"coalesce(cast({column}->>'$.{name}' as double), {float(default)}::double)"


def _r2(x: str) -> str:
    return f"cast(round(cast(cast({x} as varchar) as decimal(38,15)), 2) as double)"


def _fixed(x: str, places: int) -> str:
    return f"format('{{:.{places}f}}', cast(round(cast(cast({x} as varchar) as decimal(38,15)), {places}) as double))"


def _bank_tables(name: str) -> dict[str, str]:
    """Common tables of one prepared transaction table."""
    p = name
    return {
        f"{p}_months": f"""
select company_id, customer_id, date_trunc('month', txn_date)::date as month, sum(credit_amount) income
from {p} where category='income' group by all""",
        f"{p}_spine": f"""
select company_id, customer_id, unnest(generate_series(a, b, interval 1 month))::date as month
from (select company_id, customer_id, min(month) a, max(month) b from {p}_months group by all)""",
        f"{p}_monthly": f"""
select s.company_id, s.customer_id, s.month, coalesce(m.income, 0) income
from {p}_spine s left join {p}_months m using (company_id, customer_id, month)""",
        f"{p}_income": f"""
select company_id, customer_id, sum(income)::double / count(*)::double mean, stddev_samp(income::double) dev
from {p}_monthly group by all""",
        f"{p}_bigmonths": f"""
select company_id, customer_id, date_trunc('month', txn_date)::date as month, sum(amount) income
from {p} where type='credit' and amount>1000 group by all""",
        f"{p}_bigspine": f"""
select company_id, customer_id, unnest(generate_series(a, b, interval 1 month))::date as month
from (select company_id, customer_id, min(month) a, max(month) b from {p}_bigmonths group by all)""",
        f"{p}_big": f"""
select s.company_id, s.customer_id, sum(coalesce(m.income,0))::double / count(*)::double mean,
 stddev_samp(coalesce(m.income,0)::double) dev
from {p}_bigspine s left join {p}_bigmonths m using (company_id, customer_id, month) group by all""",
        f"{p}_inferred": f"""
select *, case when not gaps then balance_after
  when b0 is null then run else b0 + run - n0 end inferred_balance
from (select *, bool_or(balance_after is null) over k gaps,
  sum(net_change) over o as run, first_value(balance_after) over o b0, first_value(net_change) over o n0
  from {p}
  window k as (partition by company_id, customer_id),
   o as (partition by company_id, customer_id order by txn_date, seq, net_change, balance_after nulls first rows between unbounded preceding and current row))""",
        f"{p}_bal": f"""
select company_id, customer_id, sum(inferred_balance)::double/count(*)::double avg_daily_balance,
 min(inferred_balance)::double min_balance, max(inferred_balance)::double max_balance
from {p}_inferred group by all""",
        f"{p}_days": f"""
select company_id, customer_id, txn_date, count(*) n, sum(net_flow) flow,
 sum(debit_amount) debit, count(*) filter (type='debit') debit_n
from {p} group by all""",
        f"{p}_daily": f"""
select company_id, customer_id, count(*) as days, sum(case when flow>0 then 1 else 0 end) positive_days,
 sum(case when flow<0 then 1 else 0 end) negative_days, sum(flow)::double/count(*)::double avg_daily_flow,
 case when count(*)>1 then (count(*)::hugeint*sum((flow*100)::hugeint*(flow*100)::hugeint)::hugeint - sum((flow*100)::hugeint)::hugeint*sum((flow*100)::hugeint)::hugeint)::varchar::double
  / (count(*)*(count(*)-1)*10000)::double end flow_var, max(n) max_day_rows, sum(n)::double/count(*)::double avg_day_rows,
 sum(case when n>10 then 1 else 0 end) busy_days,
 sum(debit) filter (debit_n>0)::double / nullif(count(*) filter (debit_n>0),0)::double avg_daily_debit
from {p}_days group by all""",
        f"{p}_sums": f"""
select company_id, customer_id, count(*) transactions, min(txn_date) first_date, max(txn_date) last_date,
 sum(credit_amount) credit, sum(debit_amount) debit,
 sum(case when category='loan_repayment' then debit_amount else 0 end) loans,
 sum(case when category='savings' then credit_amount else 0 end) savings,
 coalesce(sum(amount) filter (debt), 0) debt, count(*) filter (debt) debt_n,
 avg_balance, min_raw_balance, balance_n, overdrawn, months
from (select *, regexp_matches(lower(description), 'loan|installment|repayment|emi|mortgage') debt from {p})
 join (select company_id, customer_id, sum(balance_after)::double/nullif(count(balance_after),0)::double avg_balance,
   min(balance_after)::double min_raw_balance, count(balance_after) balance_n,
   count(*) filter (balance_after<0) overdrawn, count(distinct date_trunc('month',txn_date)) as months
   from {p} group by all) using (company_id, customer_id) group by all""",
        f"{p}_features": f"""
select s.company_id, s.customer_id, s.transactions, s.first_date, s.last_date,
 i.mean is not null has_income, coalesce(i.mean,0) avg_monthly_income,
 coalesce(case when i.mean>0 then 1 - i.dev/i.mean end, 0) income_consistency,
 s.debit::double total_spending, s.credit::double total_credit,
 coalesce(s.debit::double/nullif(s.credit::double,0), 0) spending_to_income_ratio,
 s.loans::double loan_repayments, b.avg_daily_balance, b.min_balance, b.max_balance,
 coalesce(s.savings::double/nullif(s.credit::double,0), 0) savings_rate,
 g.mean is not null has_big_income, g.mean income_mean, g.dev income_std,
 coalesce(case when g.mean>0 then g.dev/g.mean end, 0) income_volatility,
 d.days, d.positive_days::bigint positive_days, d.negative_days::bigint negative_days,
 d.positive_days::double/d.days::double cash_flow_ratio, d.avg_daily_flow, coalesce(d.flow_var,0) cash_flow_variance,
 s.debt::double debt_payments, s.debt_n debt_payment_count,
 case when s.credit>0 then s.debt::double/s.credit::double else 0 end debt_service_ratio,
 s.balance_n>0 has_balance, s.avg_balance avg_raw_balance, s.min_raw_balance, s.months expense_months,
 coalesce(case when s.debit>0 then s.avg_balance/(s.debit::double/s.months::double) end, 0) emergency_fund_months,
 s.overdrawn overdraft_rows,
 case when s.balance_n>0 then s.overdrawn::double/s.transactions::double else 0 end overdraft_frequency,
 d.avg_day_rows, d.max_day_rows, d.busy_days::bigint busy_days, d.avg_daily_debit
from {p}_sums s join {p}_daily d using (company_id, customer_id) join {p}_bal b using (company_id, customer_id)
 left join {p}_income i using (company_id, customer_id) left join {p}_big g using (company_id, customer_id)""",
        f"{p}_large": f"""
select t.*, d.avg_daily_debit from {p} t join {p}_daily d using (company_id, customer_id)
where t.type='debit' and t.amount>1000 and t.amount::double > d.avg_daily_debit*3""",
        f"{p}_counted": f"""
select f.*, f.busy_days + coalesce(l.n,0)
 + (case when has_big_income and income_volatility>0.5 then 1 else 0 end)
 + (case when negative_days>positive_days then 1 else 0 end)
 + (case when debt_service_ratio>0.4 then 1 else 0 end)
 + (case when has_balance and emergency_fund_months<1 then 1 else 0 end)
 + (case when min_raw_balance<0 then 1 else 0 end)
 + (case when max_day_rows>20 then 1 else 0 end) bank_anomalies
from {p}_features f left join (select company_id, customer_id, count(*) n from {p}_large group by all) l
 using (company_id, customer_id)""",
    }


def _prepared(raw: str) -> str:
    return f"""
select d.*, case when type='credit' then amount else 0 end credit_amount,
 case when type='debit' then amount else 0 end debit_amount,
 case when type='credit' then amount when type='debit' then -amount else 0 end net_change,
 case when type='credit' then amount else -amount end net_flow,
 case when c.rules like '[%' then {_case(LISTED_RULES)} when c.rules like '{{%' then {_case(OBJECT_RULES)}
  else {_case(DEFAULT_RULES)} end category
from (select *, try_cast(date as date) txn_date from {raw}) d left join tenant c using (company_id)
where txn_date is not null"""


def _score(source: str, base: str, rules, score: str, tiers: str) -> dict[str, str]:
    """Rules as (name, component, condition, adjustment, text); the fired ones in long form."""
    fired = "\nunion all\n".join(
        f"select company_id, customer_id, {i} as position, '{name}' as rule_name, '{part}' as component,"
        f" cast({adj} as double) as adjustment, {text} as condition_met from {source} where {cond}"
        for i, (name, part, cond, adj, text) in enumerate(rules, 1)
    )
    parts = ", ".join(f"'{p}'" for p in dict.fromkeys(r[1] for r in rules))
    return {
        f"{score}_fired": f"select *, {base} + sum(adjustment) over (partition by company_id, customer_id"
        f" order by position rows between unbounded preceding and current row) new_score from ({fired})",
        f"{score}_final": f"""
select k.company_id, k.customer_id, greatest(0, least(1000, {base} + coalesce(sum(f.adjustment),0))) {score},
 count(f.position) rules_fired
from {source} k left join {score}_fired f using (company_id, customer_id) group by all""",
        f"{score}_out": f"select company_id, customer_id, round({score},4) {score}, {tiers.format(score)} risk_level, rules_fired from {score}_final",
        f"{score}_parts": f"""
select k.company_id, k.customer_id, p.component, round(coalesce(sum(f.adjustment),0),4) impact
from {source} k cross join (select unnest([{parts}]) component) p
 left join {score}_fired f on f.company_id=k.company_id and f.customer_id=k.customer_id and f.component=p.component
group by all""",
    }


MODULE_TIER = (
    "case when {0}>=800 then 'Very Low Risk' when {0}>=650 then 'Low Risk' when {0}>=500 then 'Medium Risk'"
    " when {0}>=350 then 'High Risk' else 'Very High Risk' end"
)
UNIFIED_TIER = (
    "case when {0}>=750 then 'Low Risk' when {0}>=600 then 'Medium Risk' when {0}>=400 then 'Medium-High Risk'"
    " else 'High Risk' end"
)


def _bank_rules():
    w = lambda n, v: _weight("bank_w", n, v)
    f = _fixed
    return [
        ("Income Consistency", "income_consistency_impact", "true", "income_consistency*200-100",
         f"'Income consistency score: ' || {f('income_consistency', 2)}"),
        ("High Average Balance", "balance_impact", "avg_daily_balance>100000", w("high_balance_bonus", 100),
         f"'Average balance: ' || {f('avg_daily_balance', 2)} || ' > 100,000'"),
        ("Low Average Balance", "balance_impact", "avg_daily_balance<5000", "-" + w("low_balance_penalty", 80),
         f"'Average balance: ' || {f('avg_daily_balance', 2)} || ' < 5,000'"),
        ("Frequent Overdraft Usage", "overdraft_impact", "overdraft_frequency>0.1", "-" + w("overdraft_penalty", 120),
         f"'Overdraft frequency: ' || {f('overdraft_frequency', 2)} || ' > 0.1'"),
        ("High Debt Service Ratio", "debt_impact", "debt_service_ratio>0.4", "-" + w("high_debt_penalty", 100),
         f"'Debt service ratio: ' || {f('debt_service_ratio', 2)} || ' > 0.4'"),
        ("Good Emergency Fund Coverage", "emergency_fund_impact", "emergency_fund_months>=3", w("emergency_fund_bonus", 80),
         f"'Emergency fund: ' || {f('emergency_fund_months', 1)} || ' months >= 3'"),
        ("Low Emergency Fund Coverage", "emergency_fund_impact", "emergency_fund_months<1", "-" + w("low_emergency_fund_penalty", 60),
         f"'Emergency fund: ' || {f('emergency_fund_months', 1)} || ' months < 1'"),
        ("High Savings Rate", "savings_impact", "savings_rate>0.15", w("high_savings_bonus", 70),
         f"'Savings rate: ' || {f('savings_rate', 2)} || ' > 0.15'"),
        ("Transaction Anomalies", "anomalies_impact", "bank_anomalies>0", "-bank_anomalies*" + w("anomaly_penalty", 25),
         "bank_anomalies || ' anomalies detected'"),
        ("High Income Volatility", "volatility_impact", "income_volatility>0.5", "-" + w("income_volatility_penalty", 50),
         f"'Income volatility: ' || {f('income_volatility', 2)} || ' > 0.5'"),
    ]


def _crb_rules():
    w = lambda n, v: _weight("crb_w", n, v)
    return [
        ("Long Credit History", "history_impact", "credit_history_months>=24", w("long_credit_history_bonus", 50),
         "'Credit History Length (' || credit_history_months || ' months) >= 24.'"),
        ("Payment Performance", "payment_impact", "true", "payment_performance_score/100.0::double*200-100",
         "'Payment performance score: ' || payment_performance_score::varchar"),
        ("High Credit Utilization", "utilization_impact", "credit_utilization_ratio>75", "-" + w("high_credit_utilization_penalty", 70),
         "'Credit Utilization Ratio (' || credit_utilization_ratio::varchar || '%) > 75%.'"),
        ("Recent Late Payments", "late_payments_impact", "recent_late_payments>0", "-recent_late_payments*" + w("late_payment_penalty_per_instance", 20),
         "recent_late_payments || ' recent late payments'"),
        ("Frequent Credit Inquiries", "inquiries_impact", "credit_inquiries>5", "-" + w("frequent_inquiries_penalty", 50),
         "credit_inquiries || ' credit inquiries'"),
    ]


def _mobile_rules():
    w = lambda n, v: _weight("mobile_w", n, v)
    f = _fixed
    return [
        ("Consistent Daily Spending", "spending_consistency_impact", "daily_spending_mean>0 and daily_spending_mean<10000", w("consistent_spending_bonus", 30),
         f"'Daily spending mean: ' || {f('daily_spending_mean', 2)} || ' within reasonable range'"),
        ("High Daily Spending", "spending_consistency_impact", "daily_spending_mean>20000", "-" + w("high_spending_penalty", 60),
         f"'Daily spending mean: ' || {f('daily_spending_mean', 2)} || ' > 20,000'"),
        ("High Mobile Loan Dependency", "loan_dependency_impact", "loan_repayment_ratio>0.3", "-" + w("high_loan_dependency_penalty", 80),
         f"'Loan repayment ratio: ' || {f('loan_repayment_ratio', 2)} || ' > 0.3'"),
        ("Manageable Mobile Loan Usage", "loan_dependency_impact", "loan_repayment_ratio>0 and loan_repayment_ratio<=0.1", w("manageable_loan_bonus", 20),
         f"'Loan repayment ratio: ' || {f('loan_repayment_ratio', 2)} || ' <= 0.1'"),
        ("Active Remittance Activity", "remittance_impact", "remittance_frequency>5", w("active_remittance_bonus", 40),
         "'Remittance frequency: ' || remittance_frequency || ' > 5'"),
        ("Mobile Money Anomalies", "anomalies_impact", "mobile_anomalies>0", "-mobile_anomalies*" + w("anomaly_penalty", 20),
         "mobile_anomalies || ' anomalies detected'"),
        ("Digital Financial Inclusion", "inclusion_impact", "true", w("digital_inclusion_bonus", 50),
         "'Active mobile money usage indicates digital financial inclusion'"),
        ("Strong Social Financial Network", "social_network_impact", "remittance_frequency>10", w("strong_social_network_bonus", 25),
         "'High P2P activity indicated by remittance frequency: ' || remittance_frequency"),
    ]


def _unified_rules():
    w = lambda n, v: _weight("unified_w", n, v)
    f = _fixed
    return [
        ("High Spending to Income Ratio", "spending_impact", "spending_to_income_ratio>0.8", "-" + w("high_spending_penalty", 50),
         f"'Spending to Income Ratio (' || {f('spending_to_income_ratio', 2)} || ') exceeded 0.8.'"),
        ("High Savings Rate", "savings_impact", "savings_rate>0.1", w("high_savings_bonus", 20),
         f"'Savings Rate (' || {f('savings_rate', 2)} || ') exceeded 0.1.'"),
        ("Detected Anomalies", "anomalies_impact", "anomalies>0", "-anomalies*" + w("anomaly_penalty_per_anomaly", 20),
         "anomalies || ' anomalies detected.'"),
        ("Excellent CRB Payment Performance", "crb_performance_impact", "crb_payment_performance>=80", w("excellent_crb_performance_bonus", 40),
         "'CRB Payment Performance (' || crb_payment_performance::varchar || ') >= 80.'"),
        ("Poor CRB Payment Performance", "crb_performance_impact", "crb_payment_performance>0 and crb_payment_performance<40", "-" + w("poor_crb_performance_penalty", 60),
         "'CRB Payment Performance (' || crb_payment_performance::varchar || ') < 40.'"),
        ("Long Credit History", "crb_history_impact", "crb_credit_history_length>=24", w("long_credit_history_bonus", 25),
         "'Credit History Length (' || crb_credit_history_length || ' months) >= 24.'"),
        ("High Credit Utilization", "crb_utilization_impact", "crb_credit_utilization>75", "-" + w("high_credit_utilization_penalty", 35),
         "'Credit Utilization (' || crb_credit_utilization::varchar || '%) > 75%.'"),
        ("High Mobile Loan Dependency", "loan_dependency_impact", "loan_repayment_ratio>0.3", "-" + w("high_mobile_loan_dependency_penalty", 45),
         f"'Mobile Loan Repayment Ratio (' || {f('loan_repayment_ratio', 2)} || ') > 0.3.'"),
        ("Good Data Completeness", "completeness_impact", "data_completeness_score>=0.67", w("good_data_completeness_bonus", 15),
         f"'Data Completeness Score (' || {f('data_completeness_score', 2)} || ') >= 0.67.'"),
        ("Consistent Spending Patterns", "spending_consistency_impact", "spending_consistency>0.8", w("spending_consistency_bonus", 20),
         f"'Spending Consistency (' || {f('spending_consistency', 2)} || ') > 0.8.'"),
    ]


CURRENCY = "coalesce(currency_preference,'KES')"


def _metric_union(source: str, section: str, rows) -> str:
    return "\nunion all\n".join(
        f"select company_id, customer_id, '{section}' section, {pos} as position, '{name}' as name, cast(null as varchar) item,"
        f" cast({value} as double) as value, {unit} as unit, {text} as description from {source} where {cond}"
        for pos, name, value, unit, text, cond in rows
    )


def _r(x: str, places: int) -> str:
    return f"cast(round(cast(cast({x} as varchar) as decimal(38,15)), {places}) as double)"


def _base_metric_rows():
    inc = "'Average income received per month.'"
    no = "'No income transactions detected.'"
    return [
        (1, "Average Monthly Income", _r("avg_monthly_income", 2), CURRENCY, f"case when has_income then {inc} else {no} end", "true"),
        (2, "Income Consistency (0-1)", _r("income_consistency", 2), "null", f"case when has_income then 'Higher indicates more stable income.' else {no} end", "true"),
        (3, "Total Spending", _r("total_spending", 2), CURRENCY, "'Total amount spent.'", "true"),
        (4, "Spending to Income Ratio", _r("spending_to_income_ratio", 2), "null", "'Percentage of total credit spent.'", "true"),
        (6, "Total Loan Repayments", _r("loan_repayments", 2), CURRENCY, "'Sum of categorized loan repayments.'", "true"),
        (7, "Average Daily Balance", _r("avg_daily_balance", 2), CURRENCY, "'Average balance maintained over the period.'", "true"),
        (8, "Minimum Balance", _r("min_balance", 2), CURRENCY, "'Lowest balance recorded.'", "true"),
        (9, "Maximum Balance", _r("max_balance", 2), CURRENCY, "'Highest balance recorded.'", "true"),
        (10, "Savings Rate", _r("savings_rate*100", 2), "'%'", "'Percentage of total credit allocated to savings.'", "true"),
    ]


def _bank_metric_rows():
    return [
        (11, "Income Volatility (CV)", _r("income_volatility", 3), "null", "'Coefficient of variation of monthly income (lower is more stable)'", "has_big_income"),
        (12, "Average Monthly Income", _r("income_mean", 2), CURRENCY, "'Average monthly income from all sources'", "has_big_income"),
        (13, "Income Standard Deviation", _r("income_std", 2), CURRENCY, "'Standard deviation of monthly income'", "has_big_income"),
        (14, "Positive Cash Flow Days", "positive_days", "null", "'Number of days with positive cash flow'", "true"),
        (15, "Negative Cash Flow Days", "negative_days", "null", "'Number of days with negative cash flow'", "true"),
        (16, "Cash Flow Ratio", _r("cash_flow_ratio", 2), "null", "'Ratio of positive to total cash flow days'", "true"),
        (17, "Average Daily Cash Flow", _r("avg_daily_flow", 2), CURRENCY, "'Average net cash flow per day'", "true"),
        (18, "Total Debt Payments", _r("debt_payments", 2), CURRENCY, "'Total amount paid towards debts'", "true"),
        (19, "Debt Service Ratio", _r("debt_service_ratio", 3), "null", "'Ratio of debt payments to total income'", "true"),
        (20, "Number of Debt Payments", "debt_payment_count", "null", "'Count of debt payment transactions'", "true"),
        (21, "Average Account Balance", _r("avg_raw_balance", 2), CURRENCY, "'Average account balance maintained'", "has_balance"),
        (22, "Minimum Balance", _r("min_raw_balance", 2), CURRENCY, "'Lowest account balance recorded'", "has_balance"),
        (23, "Emergency Fund Coverage", _r("emergency_fund_months", 1), "'months'", "'Months of expenses covered by average balance'", "has_balance"),
        (24, "Overdraft Days", "overdraft_rows", "null", "'Number of days account balance was negative'", "true"),
        (25, "Overdraft Frequency", _r("overdraft_frequency", 3), "null", "'Proportion of time account was overdrawn'", "true"),
        (26, "Average Daily Transactions", _r("avg_day_rows", 1), "null", "'Average number of transactions per day'", "true"),
        (27, "Maximum Daily Transactions", "max_day_rows", "null", "'Highest number of transactions in a single day'", "true"),
    ]


def _metrics(p: str) -> dict[str, str]:
    return {
        f"{p}_named": f"select f.*, t.currency_preference from {p}_features f left join tenant t using (company_id)",
        f"{p}_basemetrics": _metric_union(f"{p}_named", "base", _base_metric_rows())
        + f"""
union all
select company_id, customer_id, 'base', 5, 'Spending By Category', category, sum(debit_amount)::double, null,
 'Breakdown of spending by categorized types.' from {p} group by company_id, customer_id, category""",
        f"{p}_bankmetrics": _metric_union(f"{p}_named", "bank", _bank_metric_rows()),
        f"{p}_flags": f"""
select company_id, customer_id, 'Irregular Income Pattern' as type, 'High income volatility detected (CV: ' || {_fixed('income_volatility', 2)} || ')' description,
 'Income varies significantly month-to-month' reason from {p}_named where has_big_income and income_volatility>0.5
union all select company_id, customer_id, 'Negative Cash Flow Pattern', 'More days with negative cash flow than positive',
 'Negative days: ' || negative_days || ', Positive days: ' || positive_days from {p}_named where negative_days>positive_days
union all select company_id, customer_id, 'High Debt Service Ratio', 'Debt payments consume ' || {_fixed('debt_service_ratio*100', 1)} || '% of total income',
 'High debt burden may indicate financial stress' from {p}_named where debt_service_ratio>0.4
union all select company_id, customer_id, 'Low Emergency Fund', 'Average balance covers only ' || {_fixed('emergency_fund_months', 1)} || ' months of expenses',
 'Insufficient emergency fund for financial security' from {p}_named where has_balance and emergency_fund_months<1
union all select company_id, customer_id, 'Overdraft Usage', 'Account went negative to ' || {CURRENCY} || ' ' || {_fixed('min_raw_balance', 2)},
 'Overdraft usage indicates potential cash flow issues' from {p}_named where min_raw_balance<0
union all select company_id, customer_id, 'High Transaction Activity', 'Unusually high number of transactions (' || max_day_rows || ') in a single day',
 'May indicate automated trading or unusual account activity' from {p}_named where max_day_rows>20""",
    }


def _txn_anomalies(p: str, source: str) -> str:
    return f"""
select company_id, customer_id, '{source}' source, 'Unusually Large Debit' as type, strftime(txn_date,'%Y-%m-%d') txn_date, seq,
 'Transaction of ' || coalesce(t.currency_preference,'KES') || ' ' || {_fixed('amount', 2)} || ' is significantly larger than typical spending.' description,
 cast(null as varchar) reason, description txn_description, amount::double amount
from {p}_large left join tenant t using (company_id)
union all
select company_id, customer_id, '{source}', 'High Transaction Frequency', strftime(txn_date,'%Y-%m-%d'), null,
 'Multiple small transactions detected on ' || strftime(txn_date,'%Y-%m-%d') || ', potentially indicating unusual activity.',
 n || ' transactions on this day.', null, null
from {p}_days where n>10"""


CROSS_METRICS = [
    (33, "Data Completeness Score", _r("data_completeness_score", 2), "null", "'Proportion of available data sources (' || available_sources || '/3)'", "true"),
    (34, "Bank-Mobile Spending Consistency", _r("spending_consistency", 2), "null", "'Consistency between bank and mobile money spending patterns'", "spending_consistency is not null"),
    (35, "Financial Data Diversification", _r("risk_diversification_score", 2), "null", "'Score reflecting the breadth of financial data available for analysis'", "risk_diversification_score is not null"),
]
MOBILE_METRICS = [
    (36, "Average Daily Mobile Spending", _r("daily_spending_mean", 2), CURRENCY, "'Average mobile money spending on days with spending'", "true"),
    (37, "Mobile Loan Repayment Ratio", _r("loan_repayment_ratio", 3), "null", "'Ratio of mobile loan repayments to money received'", "true"),
    (38, "Number of Remittances", "remittance_frequency", "null", "'Count of money sent and received'", "true"),
    (39, "High Activity Days", "busy_days", "null", "'Number of days with more than 10 mobile money transactions'", "true"),
]
CRB_METRICS = [
    (28, "Credit History Length", "credit_history_months", "'months'", "'Length of credit history in months'", "true"),
    (29, "Number of Credit Accounts", "num_accounts", "null", "'Total number of credit accounts opened'", "true"),
    (30, "Payment Performance Score", "payment_performance_score", "null", "'Historical payment performance score'", "true"),
    (31, "Credit Utilization Ratio", "credit_utilization_ratio", "'%'", "'Percentage of available credit being used'", "true"),
    (32, "Number of Credit Types", "num_credit_types", "null", "'Diversity of credit products (e.g., loans, credit cards)'", "true"),
]

LINE = (
    r"(\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{4}|\d{4}-\d{2}-\d{2})\s+(.+?)\s+"
    r"(-?\s*(?:KSh|KES|R|\$)?\s*(?:\d{1,3}(?:,\d{3})+|\d+)\.\d{2})\s*(CR|DR)?\s*"
    r"((?:KSh|KES|R|\$)?\s*(?:\d{1,3}(?:,\d{3})+|\d+)\.\d{2})?"
)

TABLES: dict[str, str] = {
    "bank_raw": BANK_TXN,
    "linked_raw": "select * from bank_raw",
    "mobile_raw": MOBILE_TXN,
    "crb_raw": CRB,
    "crb_ok": """select * from crb_raw where payment_performance_score between 0 and 100
 and credit_utilization_ratio between 0 and 100""",
    "tenant_log": TENANT_LOG,
    "tenant": "select company_id, max(\"version\") \"version\", "
    + ", ".join(f'arg_max({c}, "version") filter (where {c} is not null) {c}' for c in LOG_COLUMNS)
    + " from tenant_log group by company_id",
    "bank": _prepared("bank_raw"),
    "linked": _prepared("linked_raw"),
    "mobile": _prepared("mobile_raw"),
    **_bank_tables("bank"),
    **_bank_tables("linked"),
    **_bank_tables("mobile"),
    **_metrics("bank"),
    **_metrics("linked"),
    "mobile_base": """
select m.company_id, m.customer_id, m.transactions, m.first_date, m.last_date, coalesce(d.avg_daily_debit,0) daily_spending_mean,
 case when credit>0 then coalesce(loans,0)::double/credit::double else 0 end loan_repayment_ratio, remittance_frequency, d.busy_days::bigint busy_days
from (select company_id, customer_id, count(*) transactions, min(txn_date) first_date, max(txn_date) last_date, sum(credit_amount) credit,
  sum(debit_amount) filter (regexp_matches(lower(description),'loan|fuliza|repayment')) loans,
  count(*) filter (regexp_matches(lower(description),'send money|receive money')) remittance_frequency
  from mobile group by all) m join mobile_daily d using (company_id, customer_id)""",
    "mobile_named": "select m.*, t.currency_preference from mobile_base m left join tenant t using (company_id)",
    "mobile_found": """
select b.*, b.busy_days + coalesce(l.n,0) mobile_anomalies from mobile_base b
 left join (select company_id, customer_id, count(*) n from mobile_large group by all) l using (company_id, customer_id)""",
    "crb_found": """
select *, (credit_history_months<12)::int + (recent_late_payments>2)::int + (credit_utilization_ratio>75)::int + (credit_inquiries>5)::int crb_anomalies from crb_ok""",
    "merged": """
select company_id, customer_id, b.* exclude (company_id, customer_id, transactions, first_date, last_date),
 b.transactions bank_transactions, b.first_date bank_first_date, b.last_date bank_last_date,
 c.credit_history_months crb_credit_history_length, c.payment_performance_score crb_payment_performance,
 c.credit_utilization_ratio crb_credit_utilization, c.num_credit_types crb_num_credit_types, c.num_accounts crb_num_accounts, c.crb_anomalies,
 m.daily_spending_mean, m.loan_repayment_ratio, m.remittance_frequency, m.mobile_anomalies,
 m.transactions mobile_transactions, m.first_date mobile_first_date, m.last_date mobile_last_date,
 (b.transactions is not null)::int bank_present, (c.credit_history_months is not null)::int crb_present, (m.transactions is not null)::int mobile_present
from linked_counted b full join crb_found c using (company_id, customer_id) full join mobile_found m using (company_id, customer_id)""",
    "crossed": """
select *, bank_present+crb_present+mobile_present available_sources,
 (bank_present+crb_present+mobile_present)::double/3::double data_completeness_score,
 case when total_spending>0 and daily_spending_mean*30>0 then
  1 - abs(total_spending-daily_spending_mean*30)/greatest(total_spending, daily_spending_mean*30) end spending_consistency,
 case when bank_present+crb_present+mobile_present>=2 then least(1.0::double, (bank_present+crb_present+mobile_present)::double/3::double) end risk_diversification_score,
 coalesce(bank_anomalies,0)+coalesce(crb_anomalies,0)+coalesce(mobile_anomalies,0) so_far
from merged""",
    "cross_found": """
select company_id, customer_id, 'CRB-Transaction Mismatch' as type,
 case when low then 'Low CRB payment performance but no transaction anomalies detected' else 'High CRB payment performance but multiple transaction anomalies detected' end description,
 case when low then 'May indicate recent improvement in financial behavior or data inconsistency' else 'May indicate recent deterioration in financial behavior' end reason
from (select *, crb_payment_performance<50 and so_far=0 low, crb_payment_performance>80 and so_far>3 high from crossed where crb_present=1 and available_sources>=2)
where low or high""",
    "unified": """
select c.*, so_far + (x.type is not null)::int anomalies from crossed c left join cross_found x using (company_id, customer_id)""",
    "bank_in": "select f.*, t.bank_w from bank_counted f left join tenant t using (company_id)",
    "spine_in": """
select k.company_id, k.customer_id, coalesce(income_consistency, 0) income_consistency, coalesce(avg_daily_balance, 0) avg_daily_balance,
 coalesce(overdraft_frequency, 0) overdraft_frequency, coalesce(debt_service_ratio, 0) debt_service_ratio, coalesce(emergency_fund_months, 0) emergency_fund_months,
 coalesce(savings_rate, 0) savings_rate, coalesce(income_volatility, 0) income_volatility, coalesce(f.bank_anomalies, 0) bank_anomalies, t.bank_w
from (select distinct company_id, customer_id from bank_raw) k
 left join (select * from bank_counted where customer_id%11<>0) f on f.company_id=k.company_id and f.customer_id=k.customer_id
 left join tenant t on t.company_id=k.company_id""",
    "crb_in": "select f.*, t.crb_w from crb_ok f left join tenant t using (company_id)",
    "mobile_in": "select f.*, t.mobile_w from mobile_found f left join tenant t using (company_id)",
    "unified_in": "select f.*, t.unified_w, t.currency_preference, t.language_preference from unified f left join tenant t using (company_id)",
    **_score("bank_in", "500.0::double", _bank_rules(), "bank_score", MODULE_TIER),
    **_score("spine_in", "500.0::double", _bank_rules(), "spine_score", MODULE_TIER),
    **_score("crb_in", "500.0::double", _crb_rules(), "crb_score", MODULE_TIER),
    **_score("mobile_in", "500.0::double", _mobile_rules(), "mobile_score", MODULE_TIER),
    **_score("unified_in", "500.0::double", _unified_rules(), "behavioral_score", UNIFIED_TIER),
    "summaries": f"""
select company_id, customer_id, coalesce(language_preference,'en') as language, {CURRENCY} currency,
 concat_ws('. ', 'Comprehensive Behavioral Analysis for Customer ' || customer_id,
  'Data Sources: ' || concat_ws(', ', case when bank_present=1 then 'Bank Transactions' end, case when mobile_present=1 then 'Mobile Money' end, case when crb_present=1 then 'Credit Bureau Data' end),
  'Overall Behavioral Score: ' || format('{{:.1f}}', behavioral_score) || '/1000 (' || case when behavioral_score>=750 then 'excellent' when behavioral_score>=600 then 'good' when behavioral_score>=400 then 'fair' else 'concerning' end || ')',
  'Risk Classification: ' || {UNIFIED_TIER.format('behavioral_score')},
  case when anomalies>0 then 'Anomalies Detected: ' || anomalies || ' patterns requiring attention' else 'No significant anomalies detected in the analyzed data' end,
  case when bank_present=1 and avg_monthly_income>0 then 'Average monthly income: ' || {CURRENCY} || ' ' || format('{{:,.2f}}', {_r2('avg_monthly_income')}) end,
  case when crb_present=1 and crb_credit_history_length>0 then 'Credit history: ' || crb_credit_history_length || ' months' end,
  case when available_sources=3 then 'Analysis based on comprehensive data from all available sources' when data_completeness_score>=0.67 then 'Analysis based on good data coverage from multiple sources'
   else 'Analysis limited by partial data availability - consider providing additional data sources for more accurate assessment' end) || '.' analysis_summary
from unified_in join behavioral_score_final using (company_id, customer_id)""",
    "slips": """
select 'S' || seq statement_id, company_id, customer_id::varchar customer_id,
 'STATEMENT OF ACCOUNT' || chr(10) || 'opening balance 0.00' || chr(10) || day || '  ' || description || ' '
 || case when seq%5=0 then 'KES ' else '' end || case when type='debit' and seq%3=0 then '-' else '' end
 || case when seq%2=0 then format('{:,.2f}', amount::double) else amount::varchar end
 || case when seq%3=0 then '' when type='debit' then ' DR' else ' CR' end
 || case when balance_after is null or balance_after<0 then '' else ' ' || format('{:,.2f}', balance_after::double) end
 || chr(10) || day || ' LEDGER FEE -KSh 12.50' || chr(10) || 'end of statement 2023' as text
from (select *, case when customer_id%2=0 then date else coalesce(strftime(try_cast(date as date),'%-d %b %Y'), date) end as day from bank_raw)""",
    "statement": """
select * from slips union all select 'D' || doc_id, source, doc_id::varchar, text from documents""",
    "parsed": f"""
select statement_id, company_id, customer_id, pos-1 as seq,
 coalesce(strftime(case when contains(g.d,'-') then try_strptime(g.d,'%Y-%m-%d') else try_strptime(g.d,'%d %b %Y') end,'%Y-%m-%d'), g.d) date,
 trim(g.t) description, abs(a)::double amount, case when upper(g.h)='DR' or a<0 then 'debit' else 'credit' end as type,
 try_cast(nullif(regexp_replace(g.b,'[^0-9.\\-]','','g'),'') as decimal(18,2))::double balance_after, 'KES' original_currency
from (select *, try_cast(regexp_replace(g.n,'[^0-9.\\-]','','g') as decimal(18,2)) a
 from (select *, regexp_extract(line, '{LINE}', ['d','t','n','h','b']) g
  from (select statement_id, company_id, customer_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)),1) pos from statement)
  where regexp_matches(line, '{LINE}')))""",
    "events_log": """
select 'J' || o_orderkey job_id, unnest(list_filter([
 {'step':1,'status':'QUEUED','message':'Job queued for processing.'},
 case when o_orderstatus<>'P' then {'step':2,'status':'PROCESSING','message':'Starting IDP processing...'} end,
 case when o_orderstatus='F' then {'step':3,'status':'COMPLETED','message':'Analysis completed successfully.'} end,
 case when o_orderstatus='O' and o_totalprice<100000 then {'step':3,'status':'FAILED','message':'Analysis failed: no text'} end], lambda x: x is not null)) s from orders""",
    "last_status": """
select job_id, s.status status, s.message message from events_log qualify row_number() over (partition by job_id order by s.step desc)=1""",
}


# Customers of some segments have no bank or no bureau record in the queries about absent sources.
PARTLY_LINKED = {
    "linked_raw": "select * from bank_raw where segment <> 'FURNITURE'",
    "crb_raw": CRB + " where c_mktsegment <> 'MACHINERY' and (c_mktsegment <> 'FURNITURE' or c_acctbal >= 0)",
}
ABSENT_SOURCES = ("q_data_completeness", "q_source_coverage", "q_cross_source", "q_unified_features")


def _sql(body: str, replaced: dict[str, str] | None = None) -> str:
    """The query with the common tables it needs, in order."""
    tables = {**TABLES, **(replaced or {})}
    needed: list[str] = []

    def add(text: str):
        for name in re.findall(r"(?:from|join)\s+([a-z_]+)", text):
            if name in tables and name not in needed:
                add(tables[name])
                needed.append(name)

    add(body)
    if not needed:
        return body
    return "with " + ",\n".join(f"{n} as materialized ({tables[n]})" for n in needed) + "\n" + body


K = "company_id, customer_id"
VECTOR = (
    "avg_monthly_income", "income_consistency", "total_spending", "spending_to_income_ratio", "loan_repayments",
    "avg_daily_balance", "min_balance", "max_balance", "savings_rate", "crb_credit_history_length",
    "crb_payment_performance", "crb_credit_utilization", "crb_num_credit_types", "daily_spending_mean",
    "loan_repayment_ratio", "remittance_frequency", "data_completeness_score", "spending_consistency",
    "risk_diversification_score", "income_volatility", "overdraft_frequency", "debt_service_ratio",
    "emergency_fund_months", "cash_flow_variance",
)
SCORECARD = {
    "avg_monthly_income": 0.0004,
    "income_consistency": 120.0,
    "total_spending": -0.00002,
    "spending_to_income_ratio": -40.0,
    "loan_repayments": -0.00005,
    "avg_daily_balance": 0.0003,
    "min_balance": 0.0001,
    "max_balance": 0.00002,
    "savings_rate": 90.0,
    "crb_credit_history_length": 0.8,
    "crb_payment_performance": 0.6,
    "crb_credit_utilization": -0.5,
    "crb_num_credit_types": 3.0,
    "daily_spending_mean": -0.0007,
    "loan_repayment_ratio": -35.0,
    "remittance_frequency": 1.5,
    "data_completeness_score": 25.0,
    "spending_consistency": 15.0,
    "risk_diversification_score": 12.0,
    "income_volatility": -20.0,
    "overdraft_frequency": -110.0,
    "debt_service_ratio": -75.0,
    "emergency_fund_months": 0.5,
    "cash_flow_variance": -0.000000001,
}


def _vector_column(c: str) -> str:
    value = f"coalesce({c}::double, 0)"
    places = {"income_consistency": 4, "income_volatility": 4}.get(c)
    return f"{value if places is None else f'round({value}, {places})'} {c}"


def _unified_columns() -> str:
    out = []
    for c in VECTOR:
        out.append(f"round({c},4) {c}" if c in ("income_consistency", "income_volatility") else f"{c}::double {c}")
    return ", ".join(out)


def _factor_rows() -> str:
    parts = " union all ".join(
        f"select {K}, '{c}' feature, (cast(round(cast(cast(coalesce({c}::double,0) as varchar) as decimal(38,12)),4) as double) - 0.25::double) * {w}::double impact from unified"
        for c, w in SCORECARD.items()
    )
    return (
        f"select {K}, row_number() over (partition by {K} order by abs(impact) desc, feature) as rank, feature, impact from ({parts})"
    )


METRIC = f"select {K}, section, position, name, item, value, unit, description from"
ANOMALY = "source, type, txn_date, seq, description, reason, txn_description, amount"


def _long_flags(source: str, name: str) -> str:
    return (
        f"select {K}, '{name}' source, type, cast(null as varchar) txn_date, cast(null as bigint) seq, description, reason,"
        f" cast(null as varchar) txn_description, cast(null as double) amount from {source}"
    )


CRB_FLAGS = f"""
select {K}, 'Credit History Length Warning' as type, 'Credit history is less than 1 year' description, 'Short credit history may impact scoring' reason from crb_ok where credit_history_months<12
union all select {K}, 'High Late Payments', recent_late_payments || ' late payments in recent credit history', 'Frequent late payments may lower credit score' from crb_ok where recent_late_payments>2
union all select {K}, 'High Credit Utilization', 'Credit utilization exceeds 75%', 'High utilization may indicate high credit dependency' from crb_ok where credit_utilization_ratio>75
union all select {K}, 'Frequent Credit Inquiries', credit_inquiries || ' inquiries in recent months', 'Frequent inquiries may indicate credit-seeking behavior' from crb_ok where credit_inquiries>5"""
TABLES["crb_flags"] = CRB_FLAGS
TABLES["bank_txn_anomalies"] = _txn_anomalies("bank", "bank")
TABLES["linked_txn_anomalies"] = _txn_anomalies("linked", "bank")
TABLES["mobile_txn_anomalies"] = _txn_anomalies("mobile", "mobile")
TABLES["bank_all_anomalies"] = (
    f"select {K}, {ANOMALY} from bank_txn_anomalies union all " + _long_flags("bank_flags", "bank")
)
TABLES["tone_text"] = """
select company_id, 'The tone should be ' || case when w='' then 'neutral and informative' else w end || '.' as text
from (select company_id, concat_ws(', ', case when (tone->>'$.professional')::boolean then 'professional' end,
 case when (tone->>'$.concise')::boolean then 'concise' end, case when (tone->>'$.avoid_jargon')::boolean then 'avoid jargon' end,
 case when (tone->>'$.include_disclaimers')::boolean then 'include clear disclaimers' end) w
 from (select company_id, coalesce(tone,'{"professional":true,"concise":true,"include_disclaimers":true}') tone from tenant))"""


def _all(module: str, score: str, what: str) -> str:
    if what == "fired":
        return (
            f"select {K}, '{module}' as module, position, rule_name, condition_met, round(adjustment,4) adjustment,"
            f" round(new_score,4) new_score from {score}_fired"
        )
    return f"select {K}, '{module}' as module, component, impact from {score}_parts"


TABLES["carded"] = (
    "select *, 500.0::double + "
    + " + ".join(f"coalesce({c}::double,0)*{w}::double" for c, w in SCORECARD.items())
    + " base_score from unified_in"
)
TABLES["carded_final"] = """
select c.company_id company_id, c.customer_id customer_id, c.base_score, greatest(0, least(1000, c.base_score + coalesce(sum(f.adjustment),0))) score
from carded c left join behavioral_score_fired f using (company_id, customer_id)
group by c.company_id, c.customer_id, c.base_score"""

BANK_PARTS = list(dict.fromkeys(r[1] for r in _bank_rules()))
MODULES = (("bank", "bank_score"), ("crb", "crb_score"), ("mobile", "mobile_score"), ("unified", "behavioral_score"))

# The ridge regression of customers' balances on the 24 features, by its normal equations: features and label are
# standardised by population moments, X'X/n gets the penalty over the label's deviation on its diagonal, and a
# Gauss-Jordan elimination with one pivot a step solves it (positive definite, so pivots stay positive).
FEATURES = len(VECTOR)
WIDTH = FEATURES + 1
REG = 0.1
TABLES["labelled"] = (
    f"select u.company_id, u.customer_id, [{', '.join(f'coalesce({c}::double,0)' for c in VECTOR)}, c_acctbal/10]::double[] xs"
    " from unified u join customer on u.company_id='T'||c_nationkey and u.customer_id::varchar=c_custkey::varchar"
)
TABLES["moments"] = f"""
select list(m order by j) m, list(case when s>1e-12*greatest(abs(m),1e-300) then s else 0 end order by j) s
from (select j, avg(x) m, stddev_pop(x) s from (select generate_subscripts(xs,1) j, unnest(xs) x from labelled) group by j)"""
TABLES["standardised"] = f"""
select list_transform(range(1,{WIDTH + 1}), lambda j: case when s[j]=0 then 0 else (xs[j]-m[j])/s[j] end) z
from labelled cross join moments"""
TABLES["normal_equations"] = f"""
select list(v order by i, j) a from (select i, j, avg(z[i]*z[j]) + case when i=j then {REG}/any_value(s[{WIDTH}]) else 0 end v
 from standardised cross join moments, range(1,{FEATURES + 1}) r(i), range(1,{WIDTH + 1}) c(j) group by i, j)"""
TABLES["solved"] = f"""
with recursive step(k, a) as (select 0, a from normal_equations union all
 select k+1, list_transform(range(0,{FEATURES * WIDTH}), lambda t: case when t//{WIDTH}=k then a[k*{WIDTH}+1+t%{WIDTH}]/a[k*{WIDTH}+1+k]
  else a[t+1]-a[(t//{WIDTH})*{WIDTH}+1+k]*a[k*{WIDTH}+1+t%{WIDTH}]/a[k*{WIDTH}+1+k] end) from step where k<{FEATURES})
select list_transform(range(1,{FEATURES + 1}), lambda j: case when s[j]=0 then 0 else a[j*{WIDTH}]*s[{WIDTH}]/s[j] end) w, m[{WIDTH}] y, m
from step cross join moments where k={FEATURES}"""
TABLES["fitted"] = f"""
select w, y - list_sum(list_transform(range(1,{FEATURES + 1}), lambda j: w[j]*m[j])) b from solved"""
TABLES["all_vectors"] = (
    f"select {K}, [{', '.join(f'coalesce({c}::double,0)' for c in VECTOR)}]::double[] xs from unified"
)
TABLES["feature_means"] = """
select list(m order by j) mean from (select j, avg(x) m from (select generate_subscripts(xs,1) j, unnest(xs) x from all_vectors) group by j)"""

TENANT_CONFIG = """select company_id, "version", coalesce(language_preference,'en') language_preference, coalesce(currency_preference,'KES') currency_preference,
 'Africa/Nairobi' timezone, true is_active, coalesce(max_file_size_mb,20) max_file_size_mb, rules rules_raw,
 case when rules like '[%' or rules like '{%' then 3 end rule_count, case when rules like '[%' then 'savings' when rules like '{%' then 'income' end first_category,
 cast(bank_w->>'$.overdraft_penalty' as double) overdraft_penalty, cast(unified_w->>'$.anomaly_penalty_per_anomaly' as double) per_anomaly, text tone
 from tenant join tone_text using (company_id)"""
_BODIES: dict[str, str] = {
    "q_crb_validate": f"""select {K}, case when payment_performance_score between 0 and 100 and credit_utilization_ratio between 0 and 100
 then 'valid' else 'rejected' end verdict, recent_late_payments, credit_inquiries, payment_performance_score, credit_utilization_ratio from crb_raw""",
    "q_statement_parse": f"select statement_id, {K}, seq, date, description, amount, type, balance_after, original_currency from parsed",
    "q_failed_statements": f"""select statement_id, {K}, text raw_text_extracted, 'failed' status, 'No transactions extracted by IDP.' error
 from statement where (statement_id, company_id, customer_id) not in (select (statement_id, company_id, customer_id) from parsed)""",
    "q_ocr_lines": "select doc_id, text || chr(10) as text from documents",
    "q_ocr_entities": f"""select 'S' || seq document_id, company_id, customer_id::varchar customer_id, 1 as seq, date, description, amount::double amount,
 case when type='unknown' then 'unknown' else type end as type, case when balance_after>=0 then balance_after::double end balance_after,
 'KES' original_currency, case when balance_after<0 then 'malformed' else 'kept' end verdict from bank_raw""",
    "q_request_seq": f"""select {K}, row_number() over (partition by {K} order by seq, date, description, amount, type, balance_after nulls first) - 1 as seq,
 date, description, amount::double amount, type, balance_after::double balance_after from bank_raw""",
    "q_crb_latest": f"""
select {K}, report, payment_performance_score, case when row_number() over (partition by {K}
  order by (payment_performance_score between 0 and 100 and credit_utilization_ratio between 0 and 100) desc, report desc) = 1 then 'kept' else 'superseded' end verdict
 from (select * replace (((customer_id*13+report*31)%104)::double as payment_performance_score)
  from (select *, unnest(range(1, (customer_id%3+2)::bigint))::int report from crb_raw))""",
    "q_document_forms": f"""
select 'S' || seq document_id, company_id, customer_id::varchar customer_id, 'entities' form, case when balance_after<0 then 'malformed' else 'kept' end verdict,
 1 as seq, date, description, amount::double amount, type, case when balance_after>=0 then balance_after::double end balance_after, 'KES' original_currency
 from bank_raw where seq%3=0
union all select statement_id, {K}, case when substr(statement_id,2)::bigint%3=1 then 'lines' else 'bytes' end, 'kept', seq, date, description, amount, type, balance_after, original_currency
 from parsed where statement_id like 'S%' and substr(case when statement_id like 'S%' then statement_id else 'S0' end,2)::bigint%3<>0""",
    "q_result_messages": f"""select company_id || '-' || customer_id job_id, {K}, 'COMPLETED' status,
 '/api/v1/analytics/results/' || company_id || '-' || customer_id result_url, substring(analysis_summary,1,200) || '...' brief_summary from summaries""",
    "q_tenant_config": TENANT_CONFIG,
    "q_tenant_snapshot": TENANT_CONFIG,
    "q_clean_txn": f"select {K}, seq, date txn_date, description, amount::double amount from bank_raw where try_cast(date as date) is not null",
    "q_txn_amounts": f"""select {K}, seq, case when type='credit' then amount else 0 end::double credit_amount, case when type='debit' then amount else 0 end::double debit_amount,
 case when type='credit' then amount when type='debit' then -amount else 0 end::double net_change, case when type='credit' then amount else -amount end::double net_flow
 from bank_raw where try_cast(date as date) is not null""",
    "q_debt_rows": f"""select {K}, seq, description, amount::double amount from bank_raw where try_cast(date as date) is not null
 and regexp_matches(lower(description), 'loan|installment|repayment|emi|mortgage')""",
    "q_categorize": f"select {K}, seq, description, category from bank",
    "q_scope": """select case when segment<>'BUILDING' then company_id else ' ' end company_id, customer_id, seq,
 case when segment<>'BUILDING' then 'scoped' else 'quarantine' end verdict from bank_raw""",
    "q_quarantine": f"""select 'bank' source, {K}, seq, 'unparsable date' reason from bank_raw where try_cast(date as date) is null
union all select 'mobile', {K}, seq, 'unparsable date' from mobile_raw where try_cast(date as date) is null
union all select 'crb', {K}, null::bigint, 'missing or out of range' from crb_raw
 where not (payment_performance_score between 0 and 100 and credit_utilization_ratio between 0 and 100)""",
    "q_result_lookup": """
select a.job_id, case when o.o_orderstatus='F' then 200 when l.status='FAILED' then 400 when l.status<>'COMPLETED' then 202 else 404 end reply_code,
 case when o.o_orderstatus='F' then least(1000.0::double, o.o_totalprice/500) end behavioral_score,
 case when o.o_orderstatus='F' then null when l.status='FAILED' then 'Job ' || a.job_id || ' failed: ' || l.message
  when l.status<>'COMPLETED' then 'Job ' || a.job_id || ' is still ' || lower(l.status) || '. Results not yet available.' else 'Analytics results not found or job ID invalid.' end detail
from (select 'J' || o_orderkey job_id from orders union select 'E' || event_id from events) a
 left join orders o on 'J' || o.o_orderkey = a.job_id left join last_status l on l.job_id=a.job_id""",
    "q_txn_with_config": f"""select {K}, seq, coalesce(language_preference,'en') as language, {CURRENCY} currency, 'Africa/Nairobi' timezone
 from bank_raw left join tenant using (company_id) where try_cast(date as date) is not null""",
    "q_large_debits": f"select {K}, seq, strftime(txn_date,'%Y-%m-%d') txn_date, amount::double amount, avg_daily_debit from bank_large",
    "q_monthly_income": f"select {K}, strftime(month,'%Y-%m-%d') as month, income::double income from bank_monthly",
    "q_unified_features": f"select {K}, bank_present, crb_present, mobile_present, bank_anomalies, crb_anomalies, mobile_anomalies, {_unified_columns()} from unified",
    "q_income_stability": f"select {K}, has_income, avg_monthly_income, round(income_consistency,4) income_consistency from bank_features",
    "q_spending_profile": f"select {K}, total_spending, total_credit, spending_to_income_ratio, loan_repayments, savings_rate from bank_features",
    "q_balance_profile": f"select {K}, avg_daily_balance, min_balance, max_balance from bank_bal",
    "q_income_volatility": f"select {K}, has_big_income, income_mean, round(income_std,4) income_std, round(income_volatility,4) income_volatility from bank_features",
    "q_cash_flow": f"select {K}, days, positive_days, negative_days, cash_flow_ratio, avg_daily_flow, cash_flow_variance from bank_features",
    "q_debt_service": f"select {K}, debt_payments, debt_payment_count, debt_service_ratio from bank_features",
    "q_liquidity": f"select {K}, has_balance, avg_raw_balance, min_raw_balance, expense_months, emergency_fund_months from bank_features",
    "q_account_behavior": f"select {K}, transactions, overdraft_rows, overdraft_frequency, avg_day_rows, max_day_rows from bank_features",
    "q_spending_by_category": f"select {K}, category, sum(debit_amount)::double spending from bank group by {K}, category",
    "q_metrics_base": f"{METRIC} bank_basemetrics",
    "q_metrics_bank": f"{METRIC} bank_bankmetrics",
    "q_crb_features": f"""select {K}, credit_history_months crb_credit_history_length, payment_performance_score crb_payment_performance, credit_utilization_ratio crb_credit_utilization,
 num_credit_types crb_num_credit_types, num_accounts crb_num_accounts, recent_late_payments crb_late_payments, credit_inquiries crb_inquiries from crb_ok""",
    "q_mobile_features": f"""select {K}, transactions, strftime(first_date,'%Y-%m-%d') first_date, strftime(last_date,'%Y-%m-%d') last_date, daily_spending_mean,
 loan_repayment_ratio, remittance_frequency, busy_days from mobile_base""",
    "q_source_coverage": f"""select {K}, bank_transactions, strftime(bank_first_date,'%Y-%m-%d') bank_first_date, strftime(bank_last_date,'%Y-%m-%d') bank_last_date,
 mobile_transactions, strftime(mobile_first_date,'%Y-%m-%d') mobile_first_date, strftime(mobile_last_date,'%Y-%m-%d') mobile_last_date, crb_credit_history_length, crb_num_accounts from merged""",
    "q_data_completeness": f"select {K}, bank_present, crb_present, mobile_present, available_sources, data_completeness_score from crossed",
    "q_cross_source": f"select {K}, spending_consistency, risk_diversification_score from crossed",
    "q_anomaly_counts": f"select {K}, bank_anomalies, crb_anomalies, mobile_anomalies, anomalies from unified",
    "q_infer_balance_splits": f"select {K}, seq, strftime(txn_date,'%Y-%m-%d') txn_date, inferred_balance::double inferred_balance from bank_inferred",
    "q_balance_profile_splits": f"select {K}, avg_daily_balance, min_balance, max_balance, has_balance, max_day_rows, cash_flow_variance from bank_features",
    "q_infer_balance": f"select {K}, seq, strftime(txn_date,'%Y-%m-%d') txn_date, inferred_balance::double inferred_balance from bank_inferred",
    "q_job_status": "select job_id, status, message from last_status",
    "q_top_factors": _factor_rows(),
    "q_metrics_all": f"{METRIC} linked_basemetrics union all {METRIC} linked_bankmetrics union all {_metric_union('crb_ok', 'crb', CRB_METRICS)} union all {_metric_union('crossed', 'cross', CROSS_METRICS)}"
    f" union all {_metric_union('mobile_named', 'mobile', MOBILE_METRICS)}",
    "q_anomalies_all": f"select {K}, {ANOMALY} from linked_txn_anomalies union all {_long_flags('linked_flags', 'bank')} union all {_long_flags('crb_flags', 'crb')}"
    f" union all select {K}, {ANOMALY} from mobile_txn_anomalies union all {_long_flags('cross_found', 'cross')}",
    "q_transactions_all": f"""select 'bank' source, {K}, seq, strftime(txn_date,'%Y-%m-%d') txn_date, description, amount::double amount, type, category, inferred_balance::double balance_after from bank_inferred
 union all select 'mobile', {K}, seq, strftime(txn_date,'%Y-%m-%d'), description, amount::double, type, category, inferred_balance::double from mobile_inferred""",
    "q_high_frequency_days": f"""select {K}, strftime(txn_date,'%Y-%m-%d') txn_date,
 'Multiple small transactions detected on ' || strftime(txn_date,'%Y-%m-%d') || ', potentially indicating unusual activity.' description, n || ' transactions on this day.' reason
 from bank_days where n>10""",
    "q_bank_anomalies": f"select {K}, type, description, reason from bank_flags",
    "q_crb_anomalies": f"select {K}, type, description, reason from crb_flags",
    "q_cross_source_anomalies": f"select {K}, type, description, reason from cross_found",
    "q_bank_features": f"""select {K}, avg_monthly_income, round(income_consistency,4) income_consistency, total_spending, spending_to_income_ratio, loan_repayments, avg_daily_balance, min_balance, max_balance,
 savings_rate, round(income_volatility,4) income_volatility, overdraft_frequency, debt_service_ratio, emergency_fund_months, cash_flow_variance, bank_anomalies from bank_counted""",
    "q_bank_score": f"select {K}, bank_score, risk_level, rules_fired from bank_score_out",
    "q_bank_score_spine": f"select {K}, spine_score bank_score, risk_level, rules_fired from spine_score_out",
    "q_crb_score": f"select {K}, crb_score, risk_level, rules_fired from crb_score_out",
    "q_mobile_score": f"select {K}, mobile_score, risk_level, rules_fired from mobile_score_out",
    "q_unified_score": f"select {K}, behavioral_score, risk_level, rules_fired from behavioral_score_out",
    "q_rule_breakdown": " union all ".join(_all(m, s, "fired") for m, s in MODULES),
    "q_score_components": " union all ".join(_all(m, s, "parts") for m, s in MODULES),
    "q_feature_vector": f"select {K}, {', '.join(_vector_column(c) for c in VECTOR)} from unified",
    "q_scorecard_score": f"""select {K}, round(base_score,4) base_score, round(score,4) behavioral_score,
 {UNIFIED_TIER.format('score')} risk_level, {len(SCORECARD)} factors from carded_final""",
    "q_model_score": f"""select {K}, round(b + list_sum(list_transform(range(1,{WIDTH}), lambda j: xs[j]*w[j])), 4) base_score from all_vectors cross join fitted""",
    "q_score_explanation": f"""
select {K}, row_number() over (partition by {K} order by abs(impact) desc, feature) as rank, feature, round(impact, 4)+0.0::double impact
from (select {K}, {list(VECTOR)}[j] feature, (xs[j]-mean[j])*w[j] impact from all_vectors cross join fitted cross join feature_means, range(1,{WIDTH}) r(j))""",
    "q_unified_summary": f"select {K}, analysis_summary, language, currency from summaries",
    "q_narrative_context": f"""
select {K}, 'metrics' block, section, position, '- ' || name || case when item is null then '' else ' / ' || item end || ': ' || coalesce({_fixed('value', 2)}, 'n/a') || ' ' || coalesce(unit,'') || ' (' || description || ')' line
 from (select * from bank_basemetrics union all select * from bank_bankmetrics)
union all select {K}, 'anomalies', source, coalesce(seq,0), '- ' || type || ': ' || description || ' (Transaction: ' || coalesce(txn_description,'N/A') || ')' from bank_all_anomalies
union all select {K}, 'rules', 'bank', position, '- ' || rule_name || ': ' || condition_met || ' (Adjustment: ' || {_fixed('adjustment', 2)} || ')' from bank_score_fired
union all select {K}, 'tone', 'tenant', 0, coalesce(text, 'The tone should be professional, concise, include clear disclaimers.') from (select distinct {K} from bank) left join tone_text using (company_id)
union all select {K}, 'anomalies', 'none', 0, 'No significant anomalies detected.' from bank_features anti join bank_all_anomalies using (company_id, customer_id)
union all select {K}, 'score', 'overall', 0, 'Overall behavioral score: ' || {_fixed('bank_score', 2)} from bank_score_final
union all select {K}, 'factors', 'components', list_position({BANK_PARTS}, component)-1, '- ' || component || ': ' || {_fixed('impact', 2)} from (select k.company_id, k.customer_id, p.component, coalesce(sum(f.adjustment),0) impact
 from bank_features k cross join (select unnest({BANK_PARTS}) component) p left join bank_score_fired f
  on f.company_id=k.company_id and f.customer_id=k.customer_id and f.component=p.component group by all)""",
}

ORACLES: dict[str, str] = {
    name: _sql(body, PARTLY_LINKED if name in ABSENT_SOURCES else None) for name, body in _BODIES.items()
}

"""Schemas, the metric dictionary and the rule parameters, as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MONEY = "decimal(20,6)"

#: Columns of the tables; money is exact, in millions.
SCHEMAS = {
    "project": "project_id string, name string, company_name string, stock_code string, industry string, fiscal_years array<string>, base_scope string, created_at string",
    "file": "file_id string, project_id string, role string, period string, rel_path string, sha256 string, bytes bigint, uploaded_at string",
    "document_page": "page_id string, file_id string, page_no int, printed_page_no string, text string, text_source string",
    "metric_definition": "metric_key string, statement string, value_type string, unit_kind string, is_derived boolean, is_nonrecurring boolean, industry string, aliases array<string>, exclusion_terms array<string>, parent_key string",
    "financial_fact": f"fact_id string, project_id string, company_id string, is_primary boolean, metric_key string, value {MONEY}, unit string, period string, period_kind string, scope string, source_file_id string, source_page int, source_text string, confidence double, status string, restated boolean, comparable boolean, incomparable_reason string, extractor string, created_at string, restatement_note string",
    "fact_observation": f"observation_id string, project_id string, company_id string, metric_key string, value {MONEY}, value_raw string, raw_unit string, period string, period_kind string, scope string, source_file_id string, source_page int, source_text string, location string, report_year int, resolution string, resolved_fact_id string, rejection_note string",
    "check_result": f"project_id string, period string, scope string, rule_key string, status string, severity string, lhs {MONEY}, rhs {MONEY}, diff {MONEY}, tolerance {MONEY}, inputs array<string>",
    "section": "section_id string, file_id string, kind string, page_from int, page_to int, text string",
    "claim": f"claim_id string, project_id string, section_id string, claim_text string, claim_type string, primary_metric string, direction string, period_norm string, magnitude_value {MONEY}, magnitude_unit string, bound string, is_plan boolean, target_metric_aligned boolean, confidence double, extractor string, report_period string",
    "claim_match": "claim_id string, verdict string, reason string, change string, deviation decimal(20,6), fact_id string, base_fact_id string",
    "q2_aging": f"project_id string, period string, scope string, receivable {MONEY}, over_one_year {MONEY}, revenue {MONEY}, status string, note string, reviewer string",
    "risk_disclosure_check": "project_id string, period string, item string, applicable boolean, risk_object string, impact_path string, evidence string, conclusion string",
    "p_confirmation": "claim_id string, is_substantive boolean, is_template boolean, missing_elements array<string>, conclusion string, reviewer string",
    "rule_config": "key string, industry string, value string, version int",
    "event": "task_id string, seq int, ts string, step_id string, type string, payload map<string,string>",
}

# The metric dictionary, as key, statement, value type, unit kind, derived, nonrecurring, industry.
DICTIONARY = (
    ("total_revenue", "income", "flow", "currency", False, False, ""),
    ("revenue", "income", "flow", "currency", False, False, ""),
    ("operating_cost", "income", "flow", "currency", False, False, ""),
    ("gross_profit", "income", "flow", "currency", True, False, ""),
    ("taxes_and_surcharges", "income", "flow", "currency", False, False, ""),
    ("selling_expense", "income", "flow", "currency", False, False, ""),
    ("admin_expense", "income", "flow", "currency", False, False, ""),
    ("rd_expense", "income", "flow", "currency", False, False, ""),
    ("finance_expense", "income", "flow", "currency", False, False, ""),
    ("interest_expense", "income", "flow", "currency", False, False, ""),
    ("interest_income", "income", "flow", "currency", False, False, ""),
    ("operating_profit", "income", "flow", "currency", False, False, ""),
    ("profit_before_tax", "income", "flow", "currency", False, False, ""),
    ("income_tax", "income", "flow", "currency", False, False, ""),
    ("net_income", "income", "flow", "currency", False, False, ""),
    ("net_income_parent", "income", "flow", "currency", False, False, ""),
    ("minority_interest_pl", "income", "flow", "currency", False, False, ""),
    ("non_gaap_net_income", "income", "flow", "currency", False, False, ""),
    ("non_recurring_gain_loss", "income", "flow", "currency", False, True, ""),
    ("government_grant", "income", "flow", "currency", False, True, ""),
    ("asset_disposal_gain_loss", "income", "flow", "currency", False, True, ""),
    ("impairment_loss", "income", "flow", "currency", False, True, ""),
    ("credit_impairment_loss", "income", "flow", "currency", False, True, ""),
    ("goodwill_impairment", "income", "flow", "currency", False, True, ""),
    ("fair_value_gain_loss", "income", "flow", "currency", False, True, ""),
    ("investment_income", "income", "flow", "currency", False, True, ""),
    ("ebit", "income", "flow", "currency", True, False, ""),
    ("ebitda", "income", "flow", "currency", True, False, ""),
    ("total_assets", "balance", "stock", "currency", False, False, ""),
    ("total_liabilities", "balance", "stock", "currency", False, False, ""),
    ("total_equity", "balance", "stock", "currency", False, False, ""),
    ("equity_parent", "balance", "stock", "currency", False, False, ""),
    ("minority_interest", "balance", "stock", "currency", False, False, ""),
    ("cash_and_equivalents", "balance", "stock", "currency", False, False, ""),
    ("accounts_receivable", "balance", "stock", "currency", False, False, ""),
    ("notes_and_ar", "balance", "stock", "currency", False, False, ""),
    ("notes_receivable", "balance", "stock", "currency", False, False, ""),
    ("inventory", "balance", "stock", "currency", False, False, ""),
    ("contract_liabilities", "balance", "stock", "currency", False, False, ""),
    ("accounts_payable", "balance", "stock", "currency", False, False, ""),
    ("ppe", "balance", "stock", "currency", False, False, ""),
    ("cip", "balance", "stock", "currency", False, False, ""),
    ("goodwill", "balance", "stock", "currency", False, False, ""),
    ("short_term_borrowing", "balance", "stock", "currency", False, False, ""),
    ("long_term_borrowing", "balance", "stock", "currency", False, False, ""),
    ("bonds_payable", "balance", "stock", "currency", False, False, ""),
    ("lease_liability", "balance", "stock", "currency", False, False, ""),
    ("interest_bearing_debt", "balance", "stock", "currency", True, False, ""),
    ("net_debt", "balance", "stock", "currency", True, False, ""),
    ("operating_working_capital", "balance", "stock", "currency", True, False, ""),
    ("cfo", "cashflow", "flow", "currency", False, False, ""),
    ("cfi", "cashflow", "flow", "currency", False, False, ""),
    ("cff", "cashflow", "flow", "currency", False, False, ""),
    ("depreciation_amortization", "cashflow", "flow", "currency", False, False, ""),
    ("amortization_intangible", "cashflow", "flow", "currency", False, False, ""),
    ("capex", "cashflow", "flow", "currency", False, False, ""),
    ("cash_net_increase", "cashflow", "flow", "currency", False, False, ""),
    ("right_of_use_asset_depreciation", "cashflow", "flow", "currency", False, False, ""),
    ("cash_begin", "cashflow", "stock", "currency", False, False, ""),
    ("cash_end", "cashflow", "stock", "currency", False, False, ""),
    ("diluted_shares", "balance", "stock", "shares", False, False, ""),
    ("eps_basic", "indicator", "flow", "currency", False, False, ""),
    ("eps_diluted", "indicator", "flow", "currency", False, False, ""),
    ("bvps", "indicator", "stock", "currency", False, False, ""),
    ("ebit_margin", "indicator", "ratio", "percent", True, False, ""),
    ("ebitda_margin", "indicator", "ratio", "percent", True, False, ""),
    ("gross_margin", "indicator", "ratio", "percent", True, False, ""),
    ("net_margin", "indicator", "ratio", "percent", True, False, ""),
    ("roe", "indicator", "ratio", "percent", True, False, ""),
    ("roic", "indicator", "ratio", "percent", True, False, ""),
    ("cash_conversion", "indicator", "ratio", "percent", True, False, ""),
    ("nonrecurring_share", "indicator", "ratio", "percent", True, False, ""),
    ("steel_output", "industry", "flow", "ton", False, False, "steel"),
    ("crude_steel_output", "industry", "flow", "ton", False, False, "steel"),
    ("steel_sales_volume", "industry", "flow", "ton", False, False, "steel"),
    ("industry_sales_volume", "industry", "flow", "ton", False, False, "steel"),
    ("coal_output", "industry", "flow", "ton", False, False, "energy"),
    ("coal_sales_volume", "industry", "flow", "ton", False, False, "energy"),
    ("steel_price_avg", "industry", "ratio", "currency", True, False, "steel"),
    ("steel_spread", "industry", "ratio", "currency", True, False, "steel"),
    ("steel_gross_profit_per_ton", "industry", "ratio", "currency", True, False, "steel"),
    ("steel_ebitda_per_ton", "industry", "ratio", "currency", True, False, "steel"),
    ("coal_price_avg", "industry", "ratio", "currency", True, False, "energy"),
    ("ton_coal_gross_margin", "industry", "ratio", "currency", True, False, "energy"),
    ("effective_capacity", "industry", "stock", "ton", False, False, "steel"),
    ("crude_steel_effective_capacity", "industry", "stock", "ton", False, False, "steel"),
    ("steel_effective_capacity", "industry", "stock", "ton", False, False, "steel"),
    ("crude_steel_capacity", "industry", "stock", "ton", False, False, "steel"),
    ("capacity_utilization", "industry", "ratio", "percent", True, False, "steel"),
    ("reported_capacity_utilization", "industry", "ratio", "percent", False, False, "steel"),
    ("safety_production_expense", "industry", "flow", "currency", False, False, "energy"),
    ("environmental_protection_expense", "industry", "flow", "currency", False, False, ""),
    ("audit_opinion", "disclosure", "text", "text", False, False, ""),
    ("accounting_policy_change", "disclosure", "text", "text", False, False, ""),
    ("safety_production_fee_increase", "balance", "flow", "currency", False, False, ""),
    ("safety_production_fee_provision", "balance", "flow", "currency", False, False, ""),
)

# Rule parameters and their defaults.
RULES = {
    "normalization.preferred_years": "8", "normalization.fallback_years": "10", "normalization.min_comparable_years": "7", "normalization.min_comparable_years_fallback": "8",
    "normalization.min_cycle_amplitude": "0.02", "normalization.crosscheck_tolerance": "0.05",
    "check.balance_tolerance": "0.005",
    "index.base": "50", "index.weight_h": "20", "index.weight_c": "20", "index.weight_r": "5", "index.weight_p": "10", "index.weight_q": "15", "index.grade_high": "70", "index.grade_low": "45", "index.min_coverage": "0.60", "index.min_observations": "5",
    "narrative.min_rel_change": "0.01", "narrative.min_ratio_change": "0.005", "narrative.min_days_change": "3", "narrative.min_utilization_change": "0.01", "narrative.forward_verifies_next_year": "1",
    "mapping.high.weights": "0.60,0.25,0.15", "mapping.medium.weights": "0.50,0.20,0.30", "mapping.low.weights": "0.35,0.15,0.50",
    "quality.days_gap": "10", "quality.share_gap": "0.005", "quality.volume_drop": "0.01", "quality.streak_years": "2",
}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def metrics(spark: SparkSession, aliases: dict[str, list[str]] | None = None, exclusions: dict[str, list[str]] | None = None) -> DataFrame:
    """The metric dictionary, with the aliases and exclusion terms of those that have some."""
    rows = [(*row, (aliases or {}).get(row[0], []), (exclusions or {}).get(row[0], []), None) for row in DICTIONARY]
    return spark.createDataFrame(rows, SCHEMAS["metric_definition"])


def rules(spark: SparkSession, own: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """Parameters with their defaults, and those of an industry or project on top."""
    rows = [(k, "", v, 1) for k, v in RULES.items()] + [(k, industry, v, 1) for (k, industry), v in (own or {}).items()]
    return spark.createDataFrame(rows, SCHEMAS["rule_config"])


def engine_parameters(spark: SparkSession) -> DataFrame:
    """``key, value`` as the operators use them, to be held against the declared ones."""
    from steelyard.operators import checks, index, quality, quantiles, verdicts

    (_, first, need), (_, second, need2) = quantiles.ATTEMPTS
    used = {
        "normalization.preferred_years": first, "normalization.fallback_years": second, "normalization.min_comparable_years": need, "normalization.min_comparable_years_fallback": need2, "normalization.min_cycle_amplitude": quantiles.AMPLITUDE, "normalization.crosscheck_tolerance": quantiles.CROSSCHECK,
        "check.balance_tolerance": checks.TOLERANCE, "index.base": index.BASE, "index.weight_h": index.H, "index.weight_c": index.C, "index.weight_r": index.R, "index.weight_p": index.P, "index.weight_q": index.Q, "index.grade_high": index.HIGH, "index.grade_low": index.LOW, "index.min_coverage": index.COVERAGE, "index.min_observations": index.OBSERVATIONS,
        "narrative.min_rel_change": verdicts.BANDS["amount"], "narrative.min_ratio_change": verdicts.BANDS["ratio"], "narrative.min_days_change": verdicts.BANDS["days"], "narrative.min_utilization_change": verdicts.BANDS["utilization"], "narrative.forward_verifies_next_year": "1",
        **{f"mapping.{g}.weights": ",".join(w) for g, w in index.WEIGHTS.items()}, "quality.days_gap": quality.DAYS_GAP, "quality.share_gap": quality.SHARE_GAP, "quality.volume_drop": quality.VOLUME_DROP.lstrip("-"), "quality.streak_years": quality.STREAK,
    }
    return spark.createDataFrame([(k, str(v)) for k, v in used.items()], "key string, value string")

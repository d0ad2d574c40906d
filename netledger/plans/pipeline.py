"""Raw archives to the clean study tables, and the shared intermediate tables built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from netledger.operators import activity, balance, canonical, enrich, ledger, privacy, stun, taint
from netledger.params import NO_USER, StudyParams
from netledger.session import materialise
from netledger.sources import txn_log
from netledger.plans import traffic
from netledger.functions.naming import ip_is_local


def clean_flows(raw_flows: list[DataFrame], raw_dns: list[DataFrame], reverse_names: DataFrame, p: StudyParams
                ) -> dict[str, DataFrame]:
    """Clean typical, peer and no-user flows, slim DNS answers, and the malformed records of both kinds, from
    overlapping raw archives.

    Stages are written where what follows reads them several times: the archives without copies, named flows (their
    distinct names are classified and joined back) and classified flows (three masks count users on them).
    """
    raw = materialise(canonical.deduplicate(raw_flows), "raw_flows")
    answers = materialise(canonical.deduplicate(raw_dns), "raw_dns")
    dns = canonical.slim_dns_with_id(canonical.dns_responses(answers))
    named = materialise(
        enrich.fill_reverse_names(enrich.attribute_dns(canonical.typical_flows(raw), dns), reverse_names), "named"
    )
    tagged = stun.tag_related_flows(materialise(enrich.classify_flows(named), "classified"))
    labelled = enrich.label_passthrough_peers(enrich.label_addresses(tagged))
    local = canonical.shift_to_local(labelled, "start_ts", "end_ts")
    in_study = materialise(canonical.trim(local, "start_ts", p.min_date, p.max_date), "labelled")
    both_ends = lambda df: canonical.trim(
        canonical.shift_to_local(df, "start_ts", "end_ts"), "start_ts", p.min_date, p.max_date
    )
    return {
        "flows_typical": canonical.finalise_flows(privacy.anonymise_flows(in_study, p.k_anonymity)),
        "flows_p2p": both_ends(canonical.p2p_flows(raw)),
        "flows_nouser": both_ends(canonical.nouser_flows(raw)),
        "dns": canonical.slim_dns(dns),
        "rejected_flows": canonical.rejected_flows(raw),
        "rejected_dns": canonical.rejected_dns(answers),
    }


def clean_transactions(lines: DataFrame, p: StudyParams) -> dict[str, DataFrame]:
    """Typed transactions, rejected lines and balances at the start of the study from the text log.

    The log has no transaction number: the number of its line (line_no, see read_lines) orders transactions of one
    second as the log has them.
    """
    parsed = materialise(txn_log.parse(txn_log.strip_nul(lines)).drop("nul_count"), "transactions")
    numbered = txn_log.accepted(parsed).withColumnRenamed("line_no", "txn_id").drop("line")
    shifted = canonical.shift_to_local(numbered, "ts")
    in_study = canonical.trim_transactions(shifted, p.min_date, p.max_date)
    return {
        "transactions": canonical.finalise_transactions(in_study),
        "rejected_lines": txn_log.rejected(parsed),
        "initial_user_balances": ledger.early_balances(shifted, p.min_date, p.ledger_cutoff),
    }


def shared_intermediates(flows: DataFrame, p2p: DataFrame, txns: DataFrame, early: DataFrame, p: StudyParams
                         ) -> dict[str, DataFrame]:
    """Gaps, user activity, daily aggregates, untainted transactions, consolidated purchases and both balances.

    The release writes a missing user as a text; here it is NULL again, so that it does not count as a user.
    """
    txns = txns.withColumns({c: F.nullif(F.col(c), F.lit(NO_USER)) for c in ("user_id", "dest_user_id")})
    gaps = materialise(activity.log_gaps(activity.all_flows(flows, p2p)), "log_gaps")
    active = materialise(activity.user_active_deltas(flows, txns, early, gaps, p.min_date, p.max_date), "active")
    bought = materialise(ledger.consolidate_purchases(txns), "purchases")
    external = flows.withColumn("is_local", ip_is_local("dest_ip"))
    return {
        "log_gaps": gaps,
        "user_active_deltas": active,
        "running_balances": ledger.running_balances(txns, p.min_date, p.max_date),
        "user_data_balance": balance.user_data_balance(external, bought, activity.eligible_users(active)),
        "untainted_transactions": taint.untainted_transactions(txns, p.exploit_start, p.exploit_end),
        "consolidated_purchases": bought,
        **{f"daily_{key}": traffic.daily_aggregate(flows, key) for key in ("category", "org", "fqdn")},
    }

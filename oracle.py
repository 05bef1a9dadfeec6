"""DuckDB SQL for every registered query.

The reports are made row by row from ``events`` and joined row by row; the KPI
formulas are written out here a second time and share nothing with the engine's.
"""

from __future__ import annotations

from netkpi.sources import catalog

_EV = """ev AS (
  SELECT date_trunc('hour', ts) AS h, user_id AS u, event_type AS t, event_id AS x,
         CAST(round(value * 100) AS BIGINT) AS v
  FROM events)"""

_NE = "concat('NE', lpad(CAST(u % 20 AS VARCHAR), 2, '0'))"
_LTE_KEYS = f"""{_NE} AS ne_name,
    CASE WHEN u % 50 = 49 THEN NULL ELSE concat('C', lpad(CAST(u AS VARCHAR), 6, '0')) END AS cell_name"""
_UMTS_KEYS = """CASE WHEN u % 50 = 49 THEN 'short' ELSE concat('S', u % 20) END AS site,
    CASE WHEN u % 50 = 49 THEN 'short' ELSE concat('S', u % 20, '_', u) END AS cell,
    CASE WHEN u % 50 = 49 THEN NULL ELSE CAST(u AS VARCHAR) END AS cell_id"""
_CN = """CASE t WHEN 'view' THEN 'CN Operator ID=0' WHEN 'click' THEN 'CN Operator ID=1'
    WHEN 'purchase' THEN 'CN Operator ID=2' WHEN 'signup' THEN 'CN Operator ID=3' END AS cn_operator"""
_LTE_LABEL = """CASE WHEN u % 50 = 49 THEN 'bad cell' ELSE concat('eNodeB Function Name=E', u % 20,
    ', Local Cell ID=', u % 6, ', Cell Name=C', lpad(CAST(u AS VARCHAR), 6, '0'), ', eNodeB ID=', u) END"""
_START = "strftime(h, '%Y-%m-%d %H:00')"

# report -> (filter, first ordinal)
_PLAN = {
    "lte_daily": ("t <> 'error'", 0),
    "lte_daily1": ("t <> 'signup'", 51),
    "lte_emtc": ("t <> 'click'", 58),
    "lte_operator": ("TRUE", 0),
    "umts_daily": ("t <> 'error'", 0),
    "umts_daily1": ("t <> 'signup'", 112),
    "umts_operator": ("TRUE", 0),
}


def _report(name: str, extra: str = "", all_kinds: bool = False) -> str:
    """CTE with the clean rows of a report."""
    report = catalog.REPORTS[name]
    where, first = _PLAN[name]
    where = "TRUE" if all_kinds else where
    counters = ",\n    ".join(
        f"CASE WHEN (min(x) + {i}) % 97 = 0 THEN 0.0 WHEN (min(x) + {i}) % 89 = 0 THEN NULL "
        f"ELSE CAST(sum((v * {2 * i + 1} + x * {i + 3}) % 1009"
        f"{' * 1000003' if c.unit in ('bit', 'byte') else ''}) AS DOUBLE) END AS {c.column}"
        for i, c in enumerate(report.counters, start=first)
    )
    keys = _LTE_KEYS if report.tech == "lte" else _UMTS_KEYS
    kind = ", t" if report.per_operator_rows else ""
    operator = f",\n    {_CN}" if report.per_operator_rows else ""
    return f"""{name} AS (
  SELECT h, {keys}{operator}{extra},
    {counters}
  FROM ev WHERE {where} GROUP BY h, u{kind})"""


def _matched(left: str, right: str, keys: tuple[str, ...]) -> str:
    return " AND ".join([f"{left}.h = {right}.h"] + [f"{left}.{k} IS NOT DISTINCT FROM {right}.{k}" for k in keys])


def _lte_joined() -> str:
    keys = catalog.KEYS["lte"]
    return ",\n".join(
        [
            _EV,
            _report("lte_daily"),
            _report("lte_daily1"),
            _report("lte_emtc"),
            f"""j AS (
  SELECT lte_daily.*, lte_daily1.* EXCLUDE (h, ne_name, cell_name), lte_emtc.* EXCLUDE (h, ne_name, cell_name)
  FROM lte_daily JOIN lte_daily1 ON {_matched("lte_daily", "lte_daily1", keys)}
  JOIN lte_emtc ON {_matched("lte_daily", "lte_emtc", keys)})""",
        ]
    )


def _umts_joined() -> str:
    keys = catalog.KEYS["umts"]
    return ",\n".join(
        [
            _EV,
            _report("umts_daily"),
            _report("umts_daily1"),
            f"""j AS (
  SELECT umts_daily.*, umts_daily1.* EXCLUDE (h, site, cell, cell_id)
  FROM umts_daily JOIN umts_daily1 ON {_matched("umts_daily", "umts_daily1", keys)})""",
        ]
    )


_DATE = "strftime(h, '%Y-%m-%d')"
_HOUR = "strftime(h, '%H:00')"
_GRAIN_KEYS = {
    "lte": {
        "day": {"date": _DATE},
        "cell": {"date": _DATE, "ne_name": "ne_name", "cell_name": "cell_name"},
        "hour": {"date": _DATE, "hour": _HOUR},
        "cell_hour": {"date": _DATE, "hour": _HOUR, "cell_name": "cell_name"},
    },
    "umts": {
        "day": {"date": _DATE},
        "cell": {"date": _DATE, "site": "site", "cell": "cell", "cell_id": "cell_id"},
        "hour": {"date": _DATE, "hour": _HOUR},
        "cell_hour": {"date": _DATE, "hour": _HOUR, "cell": "cell", "cell_id": "cell_id"},
    },
}


def _grouped(name: str, source: str, tech: str, grain: str, sums: list[str], more: list[str], where: str = "TRUE") -> str:
    """CTE with one row per grain key: sums (0 if nothing is there) and other aggregates."""
    keys = _GRAIN_KEYS[tech][grain]
    selected = [f"{expr} AS {k}" for k, expr in keys.items()]
    selected += [f"coalesce(sum({c}), 0) AS {c}" for c in sums] + more
    present = " AND ".join([f"({where})"] + [f"{expr} IS NOT NULL" for expr in keys.values()])
    return f"{name} AS (\n  SELECT {', '.join(selected)}\n  FROM {source} WHERE {present} GROUP BY {', '.join(keys.values())})"


def _div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def _r2(x: str) -> str:
    return f"round_even(({x}) * 100, 0) / 100"


def _lines(kpis: list[tuple[str, str]]) -> str:
    return ",\n  ".join(f"{sql} AS {name}" for name, sql in kpis)


_GB = "8589934592"

_LTE_NETWORK = [
    ("volte_traffic_erls", _r2("l_e_rab_sessiontime_highprecision_qci1 / (10 * 3600)")),
    ("traffic_dl_volume_gb", _r2(f"l_thrp_bits_dl / {_GB}")),
    ("traffic_ul_volume_gb", _r2(f"l_thrp_bits_ul / {_GB}")),
    ("wbb_traffic_gb", _r2(f"(l_thrp_bits_dl_qci_8 + l_thrp_bits_ul_qci_8) / {_GB}")),
    ("total_mocn_traffic_gb", _r2(f"{_r2(f'l_thrp_bits_dl / {_GB}')} + {_r2(f'l_thrp_bits_ul / {_GB}')}")),
    (
        "accessibility_ps_pct",
        _r2(
            "100 * "
            + _div("l_rrc_connreq_succ - l_rrc_connreq_succ_mosig", "l_rrc_connreq_att - l_rrc_connreq_att_mosig")
            + " * "
            + _div("l_s1sig_connest_succ", "l_s1sig_connest_att")
            + " * "
            + _div("l_e_rab_succest", "l_e_rab_attest")
        ),
    ),
    (
        "accessibility_volte_pct",
        _r2(_div("100 * l_e_rab_succest_qci_1", "l_e_rab_attest_qci_1 - l_e_rab_failest_x2ap_voip")),
    ),
    (
        "retainability_ps_pct",
        _r2(
            "100 - "
            + _div("100 * l_e_rab_abnormrel", "l_e_rab_abnormrel + l_e_rab_normrel + l_e_rab_normrel_irathoout")
        ),
    ),
    (
        "retainability_ps_pct_incl_mme",
        _r2(
            "100 - "
            + _div(
                "100 * (l_e_rab_abnormrel + l_e_rab_abnormrel_mme)",
                "l_e_rab_abnormrel + l_e_rab_normrel + l_e_rab_normrel_irathoout",
            )
        ),
    ),
    (
        "volte_ret_pct",
        _r2(
            "100 - "
            + _div(
                "100 * l_e_rab_abnormrel_qci_1",
                "l_e_rab_abnormrel_qci_1 + l_e_rab_normrel_qci_1 + l_e_rab_normrel_irathoout_qci_1",
            )
        ),
    ),
    (
        "volte_ret_pct_incl_mme",
        _r2(
            "100 - "
            + _div(
                "100 * (l_e_rab_abnormrel_qci_1 + l_e_rab_abnormrel_mme_voip)",
                "l_e_rab_abnormrel_qci_1 + l_e_rab_normrel_qci_1 + l_e_rab_normrel_irathoout_qci_1",
            )
        ),
    ),
    (
        "average_dl_throughput_mbps",
        _r2(_div("l_thrp_bits_dl - l_thrp_bits_dl_lasttti", "l_thrp_time_dl_rmvlasttti * 1000")),
    ),
    (
        "average_ul_throughput_mbps",
        _r2(_div("l_thrp_bits_ul - l_thrp_bits_ue_ul_lasttti", "l_thrp_time_ue_ul_rmvlasttti * 1000")),
    ),
    (
        "ho_intra_success_rate_pct",
        _r2(
            _div(
                "100 * (l_hho_intraenb_intrafreq_execsuccout + l_hho_interenb_intrafreq_execsuccout)",
                "l_hho_intraenb_intrafreq_prepattout + l_hho_interenb_intrafreq_prepattout",
            )
        ),
    ),
    (
        "ho_inter_success_rate_pct",
        _r2(
            _div(
                "100 * (l_hho_intraenb_interfreq_execsuccout + l_hho_interenb_interfreq_execsuccout)",
                "l_hho_intraenb_interfreq_prepattout + l_hho_interenb_interfreq_prepattout",
            )
        ),
    ),
    (
        "ho_x2_success_rate_pct",
        _r2(
            _div(
                "100 * (l_hho_x2_intrafreq_execsuccout + l_hho_x2_interfreq_execsuccout)",
                "l_hho_x2_intrafreq_prepattout + l_hho_x2_interfreq_prepattout",
            )
        ),
    ),
    (
        "ho_s1_success_rate_pct",
        _r2(
            _div(
                "100 * (l_hho_interenb_intrafreq_execsuccout - l_hho_x2_intrafreq_execsuccout"
                " + l_hho_interenb_interfreq_execsuccout - l_hho_x2_interfreq_execsuccout)",
                "l_hho_interenb_intrafreq_prepattout - l_hho_x2_intrafreq_prepattout"
                " + l_hho_interenb_interfreq_prepattout - l_hho_x2_interfreq_prepattout",
            )
        ),
    ),
    ("csfb_success_rate_pct", _r2(_div("100 * l_csfb_prepsucc", "l_csfb_prepatt"))),
    (
        "redirection_rate_pct",
        _r2(
            _div(
                "100 * (l_rrcredirection_e2w - l_rrcredirection_e2w_csfb)",
                "l_uecntx_abnormrel + l_uecntx_normrel - l_uecntx_rel_mme",
            )
        ),
    ),
    ("availability", _r2(_div("100 * (l_cell_avail_dur + l_cell_unavail_dur_energysaving)", "n_avail * 3600"))),
    ("ps_sim_users", _r2("users")),
    ("average_dl_prb_usage_pct", _r2(_div("100 * l_chmeas_prb_dl_drbused_avg", "l_chmeas_prb_dl_avail"))),
    ("max_dl_prb_usage_pct", f"round_even({_div('100 * max_dl_used', 'max_dl_avail')}, 0)"),
    ("average_ul_prb_usage_pct", _r2(_div("100 * l_chmeas_prb_ul_drbused_avg", "l_chmeas_prb_ul_avail"))),
    ("max_ul_prb_usage_pct", _r2(_div("100 * max_ul_used", "max_ul_avail"))),
]

_LTE_OPERATOR = [
    ("volte_traffic_erls", _r2("l_e_rab_sessiontime_highprecision_plmn_qci1 / (10 * 3600)")),
    ("traffic_dl_volume_gb", _r2(f"l_thrp_bits_dl_plmn / {_GB}")),
    ("traffic_ul_volume_gb", _r2(f"l_thrp_bits_ul_plmn / {_GB}")),
    ("wbb_traffic_gb", _r2(f"(l_thrp_bits_dl_plmn_qci_8 + l_thrp_bits_ul_plmn_qci_8) / {_GB}")),
    ("total_mocn_traffic_gb", _r2(f"{_r2(f'l_thrp_bits_dl_plmn / {_GB}')} + {_r2(f'l_thrp_bits_ul_plmn / {_GB}')}")),
    ("accessibility_ps_pct", _r2(_div("100 * l_e_rab_succest_plmn", "l_e_rab_attest_plmn"))),
    ("accessibility_volte_pct", _r2(_div("100 * l_e_rab_succest_plmn_qci_1", "l_e_rab_attest_plmn_qci_1"))),
    (
        "retainability_ps_pct",
        _r2(
            "100 - "
            + _div(
                "100 * l_e_rab_abnormrel_plmn",
                "l_e_rab_abnormrel_plmn + l_e_rab_normrel_plmn + l_iratho_e2w_execsuccout_plmn",
            )
        ),
    ),
    (
        "retainability_ps_pct_incl_mme",
        _r2(
            "100 - "
            + _div(
                "100 * (l_e_rab_abnormrel_plmn + l_e_rab_abnormrel_mme_plmn)",
                "l_e_rab_abnormrel_plmn + l_e_rab_normrel_plmn + l_iratho_e2w_execsuccout_plmn",
            )
        ),
    ),
    (
        "volte_ret_pct",
        _r2(
            "100 - "
            + _div("100 * l_e_rab_abnormrel_plmn_qci_1", "l_e_rab_abnormrel_plmn_qci_1 + l_e_rab_normrel_plmn_qci_1")
        ),
    ),
    (
        "volte_ret_pct_incl_mme",
        _r2(
            "100 - "
            + _div(
                "100 * (l_e_rab_abnormrel_plmn_qci_1 + l_e_rab_abnormrel_mme_voip_plmn)",
                "l_e_rab_abnormrel_plmn_qci_1 + l_e_rab_normrel_plmn_qci_1",
            )
        ),
    ),
    (
        "average_dl_throughput_mbps",
        _r2(_div("l_thrp_bits_dl_plmn - l_thrp_bits_dl_lasttti_plmn", "l_thrp_time_dl_rmvlasttti_plmn * 1000")),
    ),
    (
        "average_ul_throughput_mbps",
        _r2(_div("l_thrp_bits_ul_plmn - l_thrp_bits_ue_ul_lasttti_plmn", "l_thrp_time_ue_ul_rmvlasttti_plmn * 1000")),
    ),
    (
        "ho_intra_success_rate_pct",
        _r2(
            _div(
                "100 * (l_hho_intraenb_intrafreq_execsuccout_plmn + l_hho_interenb_intrafreq_execsuccout_plmn)",
                "l_hho_intraenb_intrafreq_prepattout_plmn + l_hho_interenb_intrafreq_prepattout_plmn",
            )
        ),
    ),
    (
        "ho_inter_success_rate_pct",
        _r2(
            _div(
                "100 * (l_hho_intraenb_interfreq_execsuccout_plmn + l_hho_interenb_interfreq_execsuccout_plmn)",
                "l_hho_intraenb_interfreq_prepattout_plmn + l_hho_interenb_interfreq_prepattout_plmn",
            )
        ),
    ),
    (
        "ho_x2_success_rate_pct",
        _r2(
            _div(
                "100 * (l_hho_x2_intrafreq_execsuccout_plmn + l_hho_x2_interfreq_execsuccout_plmn)",
                "l_hho_x2_intrafreq_prepattout_plmn + l_hho_x2_interfreq_prepattout_plmn",
            )
        ),
    ),
    (
        "ho_s1_success_rate_pct",
        _r2(
            _div(
                "100 * (l_hho_interenb_intrafreq_execsuccout_plmn - l_hho_x2_intrafreq_execsuccout_plmn"
                " + l_hho_interenb_interfreq_execsuccout_plmn - l_hho_x2_interfreq_execsuccout_plmn)",
                "l_hho_interenb_intrafreq_prepattout_plmn - l_hho_x2_intrafreq_prepattout_plmn"
                " + l_hho_interenb_interfreq_prepattout_plmn - l_hho_x2_interfreq_prepattout_plmn",
            )
        ),
    ),
    ("csfb_success_rate_pct", _r2(_div("100 * l_csfb_prepsucc_plmn", "l_csfb_prepatt_plmn"))),
    (
        "redirection_rate_pct",
        _r2(
            _div(
                "100 * (l_rrcredirection_e2w_plmn - l_rrcredirection_e2w_csfb_plmn)",
                "l_uecntx_abnormrel + l_uecntx_normrel - l_uecntx_rel_mme",
            )
        ),
    ),
    ("availability", _r2(_div("100 * (l_cell_avail_dur + l_cell_unavail_dur_energysaving)", "n_avail * 3600"))),
    ("ps_sim_users", _r2("users_plmn")),
    ("average_dl_prb_usage_pct", _r2(_div("100 * l_rbusedown_dl_plmn", "l_chmeas_prb_dl_avail"))),
    ("max_dl_prb_usage_pct", f"round_even({_div('100 * max_dl_own', 'max_ul_own')}, 0)"),
    ("average_ul_prb_usage_pct", _r2(_div("100 * l_rbusedown_ul_plmn", "l_chmeas_prb_ul_avail"))),
    ("max_ul_prb_usage_pct", _r2(_div("100 * max_ul_own", "max_ul_avail"))),
]

_LTE_MORE = [
    "avg(l_traffic_user_avg) AS users",
    "count(l_cell_avail_dur) AS n_avail",
    "max(l_chmeas_prb_dl_drbused_avg) AS max_dl_used",
    "max(l_chmeas_prb_dl_avail) AS max_dl_avail",
    "max(l_chmeas_prb_ul_drbused_avg) AS max_ul_used",
    "max(l_chmeas_prb_ul_avail) AS max_ul_avail",
]
_LTE_SUMS = [
    c
    for r in ("lte_daily", "lte_daily1", "lte_emtc")
    for c in catalog.REPORTS[r].columns
    if c != "l_traffic_user_avg"
]


def _lte_network(name: str, grain: str) -> str:
    """CTEs ``name``: network KPIs of a grain, out of ``j``."""
    keys = ", ".join(_GRAIN_KEYS["lte"][grain])
    grouped = _grouped(f"g_{name}", "j", "lte", grain, _LTE_SUMS, _LTE_MORE)
    return f"{grouped},\n{name} AS (\n  SELECT {keys},\n  {_lines(_LTE_NETWORK)}\n  FROM g_{name})"


_IN_SLICE = {
    "a": "cn_operator = 'CN Operator ID=0' OR cn_operator = 'CN Operator ID=1'",
    "b": "cn_operator = 'CN Operator ID=2'",
}


def _lte_operator(name: str, grain: str, slice_name: str) -> str:
    keys = ", ".join(_GRAIN_KEYS["lte"][grain])
    own = _grouped(
        f"p_{name}",
        "lte_operator",
        "lte",
        grain,
        [c for c in catalog.LTE_OPERATOR.columns if c != "l_traffic_user_avg_plmn"],
        [
            "avg(l_traffic_user_avg_plmn) AS users_plmn",
            "max(l_rbusedown_dl_plmn) AS max_dl_own",
            "max(l_rbusedown_ul_plmn) AS max_ul_own",
        ],
        _IN_SLICE[slice_name],
    )
    network = _grouped(f"n_{name}", "j", "lte", grain, _LTE_SUMS, _LTE_MORE)
    return f"{own},\n{network},\n{name} AS (\n  SELECT {keys},\n  {_lines(_LTE_OPERATOR)}\n  FROM p_{name} JOIN n_{name} USING ({keys}))"


def _plus(*names: str) -> str:
    return "(" + " + ".join(names) + ")"


_WIDTHS = ["8", "16", "32", "64", "128", "144", "256", "384"]
_DL_BITS = _plus(
    *[f"vs_ps_bkg_dl_{b}_traffic" for b in _WIDTHS],
    *[f"vs_ps_int_dl_{b}_traffic" for b in _WIDTHS],
    *[f"vs_ps_str_dl_{b}_traffic" for b in _WIDTHS],
    "vs_ps_conv_dl_traffic",
    "vs_dcchsrb_dl_traffic",
)
_UL_BITS = _plus(
    *[f"vs_ps_bkg_ul_{b}_traffic" for b in _WIDTHS],
    *[f"vs_ps_int_ul_{b}_traffic" for b in _WIDTHS],
    *[f"vs_ps_str_ul_{b}_traffic" for b in _WIDTHS[:5]],
    "vs_ps_conv_ul_traffic",
    "vs_dcchsrb_ul_traffic",
)
_DL_BYTES = _plus("vs_hsdpa_meanchthroughput_totalbytes", "vs_srnciubbytespsfach_tx", "vs_srnciubbytespsefach_tx")
_UL_BYTES = _plus("vs_hsupa_meanchthroughput_totalbytes", "vs_srnciubbytespsrach_rx", "vs_srnciubbytespserach_rx")
_PCH_SUCC = _plus("vs_succcellupdt_orgconvcall_pch", "vs_succcellupdt_emgcall_pch", "vs_succcellupdt_tmconvcall_pch")
_PCH_ATT = _plus("vs_attcellupdt_orgconvcall_pch", "vs_attcellupdt_tmconvcall_pch", "vs_attcellupdt_emgcall_pch")
_CONV_SUCC = _plus(
    "rrc_succconnestab_orgconvcall", "rrc_succconnestab_tmconvcall", "rrc_succconnestab_emgcall"
)
_CONV_ATT = _plus("rrc_attconnestab_orgconvcall", "rrc_attconnestab_tmconvcall", "rrc_attconnestab_emgcall")
_PS_SUCC = _plus(
    "rrc_succconnestab_orgbkgcall", "rrc_succconnestab_tmbkgcall", "rrc_succconnestab_orgintercall",
    "rrc_succconnestab_tmitrcall", "rrc_succconnestab_orgstrcall", "rrc_succconnestab_tmstrcall",
    "rrc_succconnestab_orghhprsig", "rrc_succconnestab_tmhhprsig", "rrc_succconnestab_orglwprsig",
    "rrc_succconnestab_tmlwprsig", "rrc_succconnestab_orgsubcall", "rrc_succconnestab_unkown",
    "rrc_succconnestab_callreest", "vs_succcellupdt_pagersp", "vs_succcellupdt_uldatatrans",
)
_PS_ATT = _plus(
    "rrc_attconnestab_orgbkgcall", "rrc_attconnestab_tmbkgcall", "rrc_attconnestab_orgintercall",
    "rrc_attconnestab_tmintercall", "rrc_attconnestab_orgstrcall", "rrc_attconnestab_tmstrcall",
    "rrc_attconnestab_orghhprsig", "rrc_attconnestab_tmhhprsig", "rrc_attconnestab_orglwprsig",
    "rrc_attconnestab_tmlwprsig", "rrc_attconnestab_orgsubcall", "rrc_attconnestab_unknown",
    "rrc_attconnestab_callreest", "vs_attcellupdt_pagersp", "vs_attcellupdt_uldatatrans",
)
_RAB_PS_SUCC = _plus(
    "vs_rab_succestabps_conv", "vs_rab_succestabps_str", "vs_rab_succestabps_int", "vs_rab_succestabps_bkg"
)
_RAB_PS_ATT = _plus(
    "vs_rab_attestabps_conv", "vs_rab_attestabps_str", "vs_rab_attestabps_int", "vs_rab_attestabps_bkg"
)
_RAB_CS_SUCC = _plus("vs_rab_succestabcs_conv", "vs_rab_succestabcs_str")
_RAB_CS_ATT = _plus("vs_rab_attestabcs_conv", "vs_rab_attestabcs_str")
_UMTS_DL = _r2(f"{_DL_BYTES} / 1073741824 + {_DL_BITS} / {_GB}")
_UMTS_UL = _r2(f"{_UL_BYTES} / 1073741824 + {_UL_BITS} / {_GB}")

_UMTS_NETWORK = [
    ("voice_erlangs", _r2("(vs_amr_erlang_bestcell + vs_vp_erlang_bestcell) * (30 / 60)")),
    ("traffic_dl_volume_gb", _UMTS_DL),
    ("traffic_ul_volume_gb", _UMTS_UL),
    ("total_mocn_traffic_gb", f"{_UMTS_UL} + {_UMTS_DL}"),
    (
        "accessibility_cs_pct",
        _r2(
            f"100 * {_div(f'{_CONV_SUCC} + {_PCH_SUCC}', f'{_CONV_ATT} + {_PCH_ATT}')} * {_div(_RAB_CS_SUCC, _RAB_CS_ATT)}"
        ),
    ),
    (
        "accessibility_ps_pct",
        _r2(
            f"100 * {_div(f'{_PS_SUCC} - {_PCH_SUCC}', f'{_PS_ATT} - {_PCH_ATT}')} * "
            + _div(f"{_RAB_PS_SUCC} + vs_dccc_succ_f2d_afterp2f", f"{_RAB_PS_ATT} + vs_dccc_att_f2d_afterp2f")
        ),
    ),
    ("average_dl_throughput_mbps", _r2("dl_rate")),
    ("average_ul_throughput_mbps", _r2("ul_rate")),
    ("availability", _r2(f"100 - {_div('vs_cell_unavailtime_sys', 'n_unavail * 3600')}")),
    ("ps_sim_users", _r2("users * 30 / 60")),
]
_UMTS_MORE = [
    "avg(vs_hsdpa_meanchthroughput) AS dl_rate",
    "avg(vs_hsupa_meanchthroughput) AS ul_rate",
    "avg(vs_celldchues) AS users",
    "count(vs_cell_unavailtime_sys) AS n_unavail",
]
_UMTS_MEANS = ("vs_hsdpa_meanchthroughput", "vs_hsupa_meanchthroughput", "vs_celldchues")
_UMTS_SUMS = [
    c for r in ("umts_daily", "umts_daily1") for c in catalog.REPORTS[r].columns if c not in _UMTS_MEANS
]


def _umts_network(name: str, grain: str) -> str:
    keys = ", ".join(_GRAIN_KEYS["umts"][grain])
    grouped = _grouped(f"g_{name}", "j", "umts", grain, _UMTS_SUMS, _UMTS_MORE)
    return f"{grouped},\n{name} AS (\n  SELECT {keys},\n  {_lines(_UMTS_NETWORK)}\n  FROM g_{name})"


_PLMNS = {"a": ("0", "1"), "b": ("2",)}


def _umts_operator(name: str, grain: str, slice_name: str) -> str:
    keys = ", ".join(_GRAIN_KEYS["umts"][grain])
    down, up, voice = (
        _plus(*[f"{c}_plmn{p}" for p in _PLMNS[slice_name]])
        for c in ("vs_psload_dlthruput_mocn", "vs_psload_ulthruput_mocn", "vs_cs_erlang_equiv_mocn")
    )
    grouped = _grouped(f"g_{name}", "umts_operator", "umts", grain, catalog.UMTS_OPERATOR.columns, [])
    kpis = [
        ("traffic_dl_volume_gb", _r2(f"{down} / {_GB}")),
        ("traffic_ul_volume_gb", _r2(f"{up} / {_GB}")),
        ("voice_erlangs", _r2(f"{voice} * (30 / 60)")),
        ("total_mocn_traffic_gb", f"{_r2(f'{down} / {_GB}')} + {_r2(f'{up} / {_GB}')}"),
    ]
    return f"{grouped},\n{name} AS (\n  SELECT {keys},\n  {_lines(kpis)}\n  FROM g_{name})"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


_GRAINS = ("day", "cell", "hour", "cell_hour")
_KEY_COLUMNS = {"lte": ["date", "hour", "ne_name", "cell_name"], "umts": ["date", "hour", "site", "cell", "cell_id"]}


def _all_grains(tech: str) -> str:
    network = _lte_network if tech == "lte" else _umts_network
    kpis = [name for name, _ in (_LTE_NETWORK if tech == "lte" else _UMTS_NETWORK)]
    parts = []
    for grain in _GRAINS:
        keys = [k if k in _GRAIN_KEYS[tech][grain] else f"CAST(NULL AS VARCHAR) AS {k}" for k in _KEY_COLUMNS[tech]]
        parts.append(f"SELECT '{grain}' AS grain, {', '.join(keys + kpis)} FROM t_{grain}")
    joined = _lte_joined() if tech == "lte" else _umts_joined()
    return _with(joined, *[network(f"t_{g}", g) for g in _GRAINS]) + "\nUNION ALL\n".join(parts)


_INTEGRITY = """integrity AS (
  SELECT count(DISTINCT CASE WHEN h = (SELECT min(h) FROM j) THEN cell_name END) AS cells_before,
         count(DISTINCT CASE WHEN h = (SELECT max(h) FROM j) THEN cell_name END) AS cells_after
  FROM j)"""

_LTE_SUMMARY = [
    ("Traffic", "PS Sim Users", "ps_sim_users"),
    ("Traffic", "VoLTE Traffic(Erls)", "volte_traffic_erls"),
    ("Traffic", "Traffic DL Volume (GB)", "traffic_dl_volume_gb"),
    ("Traffic", "Traffic UL Volume (GB)", "traffic_ul_volume_gb"),
    ("Traffic", "WBB traffic (GB)", "wbb_traffic_gb"),
    ("Traffic", "Total MOCN traffic (GB)", "total_mocn_traffic_gb"),
    ("Accessibility", "Accessibility PS (%)", "accessibility_ps_pct"),
    ("Accessibility", "Accessibility VoLTE (%)", "accessibility_volte_pct"),
    ("Retainability", "Retainability PS (%)", "retainability_ps_pct"),
    ("Retainability", "Retainability PS (%) (incl. MME)", "retainability_ps_pct_incl_mme"),
    ("Retainability", "VoLTE Ret (%)", "volte_ret_pct"),
    ("Retainability", "VoLTE Ret (%) (incl. MME)", "volte_ret_pct_incl_mme"),
    ("Integrity", "Throughput DL Average (Mbps)", "average_dl_throughput_mbps"),
    ("Integrity", "Throughput UL Average (Mbps)", "average_ul_throughput_mbps"),
    ("Integrity", "PRB Usage DL Average (%)", "average_dl_prb_usage_pct"),
    ("Integrity", "PRB Usage DL Max (%)", "max_dl_prb_usage_pct"),
    ("Integrity", "PRB Usage UL Average (%)", "average_ul_prb_usage_pct"),
    ("Integrity", "PRB Usage UL Max (%)", "max_ul_prb_usage_pct"),
    ("Integrity", "Cell Configuration Integrity", ""),
    ("Mobility", "HO Intra Success Rate (%)", "ho_intra_success_rate_pct"),
    ("Mobility", "HO Inter Success Rate (%)", "ho_inter_success_rate_pct"),
    ("Mobility", "HO S1 Success Rate (%)", "ho_s1_success_rate_pct"),
    ("Mobility", "CSFB Success Rate (%)", "csfb_success_rate_pct"),
    ("Mobility", "Redirection Rate (%)", "redirection_rate_pct"),
    ("Availability", "Availability", "availability"),
]
_UMTS_SUMMARY = [
    ("Traffic", "PS Sim Users", "ps_sim_users"),
    ("Traffic", "Voice Erlangs", "voice_erlangs"),
    ("Traffic", "Traffic DL Volume (GB)", "traffic_dl_volume_gb"),
    ("Traffic", "Traffic UL Volume (GB)", "traffic_ul_volume_gb"),
    ("Traffic", "Total MOCN Traffic(GB)", "total_mocn_traffic_gb"),
    ("Accessibility", "Accessibility CS (%)", "accessibility_cs_pct"),
    ("Accessibility", "Accessibility PS (%)", "accessibility_ps_pct"),
    ("Integrity", "Throughput DL Average (Mbps)", "average_dl_throughput_mbps"),
    ("Integrity", "Throughput UL Average (Mbps)", "average_ul_throughput_mbps"),
    ("Availability", "Availability", "availability"),
]


def _summary(tech: str) -> str:
    rows = _LTE_SUMMARY if tech == "lte" else _UMTS_SUMMARY
    if tech == "lte":
        ctes = [
            _lte_joined(),
            _report("lte_operator"),
            _lte_network("d_all", "day"),
            _lte_operator("d_a", "day", "a"),
            _lte_operator("d_b", "day", "b"),
            _INTEGRITY,
        ]
    else:
        ctes = [
            _umts_joined(),
            _report("umts_operator"),
            _umts_network("d_all", "day"),
            _umts_operator("d_a", "day", "a"),
            _umts_operator("d_b", "day", "b"),
        ]
    parts = []
    for position, (section, label, column) in enumerate(rows, start=1):
        if not column:
            before, after, a, b = (f"(SELECT CAST({c} AS DOUBLE) FROM integrity)" for c in
                                   ("cells_before", "cells_after", "cells_after", "cells_after"))
        else:
            before = f"(SELECT {column} FROM d_all ORDER BY date LIMIT 1)"
            after = f"(SELECT {column} FROM d_all ORDER BY date DESC LIMIT 1)"
            has_operator = label != "Availability" if tech == "lte" else label in [r[1] for r in rows[1:5]]
            a, b = (
                f"(SELECT {column} FROM d_{s} ORDER BY date DESC LIMIT 1)" if has_operator else "CAST(NULL AS DOUBLE)"
                for s in "ab"
            )
        shared = section == "Traffic" and not (tech == "umts" and label == "PS Sim Users")
        share = _div(b, f"{b} + {a}") if shared else "CAST(NULL AS DOUBLE)"
        parts.append(
            f"SELECT {position} AS position, '{tech}' AS tech, '{section}' AS section, '{label}' AS kpi, "
            f"{before} AS before_all, {after} AS after_all, {a} AS after_a, {b} AS after_b, {share} AS share_b, "
            "(SELECT max(date) FROM d_all) AS after_date"
        )
    return _with(*ctes) + "\nUNION ALL\n".join(parts)


def _sink() -> str:
    tables = []
    ctes = [_umts_joined(), _report("umts_operator")]
    for grain in _GRAINS:
        ctes.append(_umts_network(f"t_all_{grain}", grain))
        tables.append(("ALL", grain, f"t_all_{grain}"))
        for s in "ab":
            ctes.append(_umts_operator(f"t_{s}_{grain}", grain, s))
            tables.append((s.upper(), grain, f"t_{s}_{grain}"))
    return _with(*ctes) + "\nUNION ALL\n".join(
        f"SELECT '{s}' AS slice, '{g}' AS grain, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, "
        f"max(traffic_dl_volume_gb) AS max_dl_gb FROM {t}"
        for s, g, t in tables
    )


def _few_names(ctes: str) -> str:
    """Ten cell names instead of one per cell."""
    return ctes.replace("concat('C', lpad(CAST(u AS VARCHAR), 6, '0'))", "concat('C', u % 10)")


def _sink_tables(tech: str) -> tuple[list[str], list[tuple[str, str, str]]]:
    """CTEs of all twelve tables; slice, grain and name of each."""
    if tech == "lte":
        ctes, network, operator = [_lte_joined(), _report("lte_operator")], _lte_network, _lte_operator
    else:
        ctes, network, operator = [_umts_joined(), _report("umts_operator")], _umts_network, _umts_operator
    tables = []
    for grain in _GRAINS:
        ctes.append(network(f"t_all_{grain}", grain))
        tables.append(("ALL", grain, f"t_all_{grain}"))
        for s in "ab":
            ctes.append(operator(f"t_{s}_{grain}", grain, s))
            tables.append((s.upper(), grain, f"t_{s}_{grain}"))
    return ctes, tables


def _sink_values(tech: str) -> str:
    ctes, tables = _sink_tables(tech)
    return _with(*ctes) + "\nUNION ALL BY NAME\n".join(f"SELECT '{s}' AS slice, '{g}' AS grain, * FROM {t}" for s, g, t in tables)


def _sink_order() -> str:
    ctes, tables = _sink_tables("lte")
    return _with(*ctes) + "\nUNION ALL\n".join(
        f"SELECT '{s}' AS slice, '{g}' AS grain, count(*) AS n_rows, 0 AS out_of_place FROM {t}" for s, g, t in tables
    )


def _partials(sums: list[str], counts: list[str], maxima: list[str]) -> str:
    return ", ".join(
        [f"sum({c}) AS {c}" for c in sums]
        + [f"count({c}) AS n_{c}" for c in counts]
        + [f"max({c}) AS max_{c}" for c in maxima]
    )


_LTE_ALL = [c for r in ("lte_daily", "lte_daily1", "lte_emtc") for c in catalog.REPORTS[r].columns]
_PRB = [
    "l_chmeas_prb_dl_avail",
    "l_chmeas_prb_ul_avail",
    "l_chmeas_prb_dl_drbused_avg",
    "l_chmeas_prb_ul_drbused_avg",
]
_TERMS = {
    "dl_bytes": _DL_BYTES,
    "dl_bits": _DL_BITS,
    "ul_bytes": _UL_BYTES,
    "ul_bits": _UL_BITS,
    "voice_rrc_succ": _CONV_SUCC,
    "voice_rrc_att": _CONV_ATT,
    "voice_update_succ": _PCH_SUCC,
    "voice_update_att": _PCH_ATT,
    "cs_rab_succ": _RAB_CS_SUCC,
    "cs_rab_att": _RAB_CS_ATT,
    "ps_rrc_succ": _PS_SUCC,
    "ps_rrc_att": _PS_ATT,
    "ps_rab_succ": _RAB_PS_SUCC,
    "ps_rab_att": _RAB_PS_ATT,
}


def _term_sums() -> str:
    """Each term as the sum of the sums of its counters."""
    parts = []
    for name, sql in _TERMS.items():
        counters = sql.strip("()").split(" + ")
        parts.append(" + ".join(f"coalesce(sum({c}), 0)" for c in counters) + f" AS {name}")
    return ", ".join(parts)


def _umts_join_sql() -> str:
    single = [
        "vs_amr_erlang_bestcell",
        "vs_vp_erlang_bestcell",
        *_UMTS_MEANS,
        "vs_cell_unavailtime_sys",
        "vs_dccc_succ_f2d_afterp2f",
        "vs_dccc_att_f2d_afterp2f",
    ]
    aggregates = _partials(single, [*_UMTS_MEANS, "vs_cell_unavailtime_sys"], [])
    return _with(_umts_joined()) + (
        f"SELECT {_START} AS start_time, site, cell, cell_id, {_term_sums()}, {aggregates}, "
        "count(*) AS joined_rows FROM j GROUP BY h, site, cell, cell_id"
    )


def _text_start() -> str:
    return f"{_START} AS start_time, {_LTE_LABEL} AS label"


def all_sql() -> dict[str, str]:
    found = {
        "nil_to_zero": _with(_EV, _report("lte_daily1", f", {_text_start()}", all_kinds=True))
        + f"SELECT start_time, label, {', '.join(catalog.LTE_DAILY1.columns)} FROM lte_daily1",
        "lte_cell_name": _with(_EV)
        + f"SELECT {_text_start()}, CASE WHEN u % 50 = 49 THEN NULL ELSE concat('C', lpad(CAST(u AS VARCHAR), 6, '0')) "
        "END AS cell_name FROM ev GROUP BY h, u",
        "umts_label_parse": _with(_EV)
        + f"SELECT {_START} AS start_time, CASE WHEN u % 50 = 49 THEN 'Label=short' ELSE concat('Label=S', u % 20, '_', u, "
        f"', CellID=', u, ', LogicRNCID=1') END AS label, {_UMTS_KEYS} FROM ev GROUP BY h, u",
        "time_keys": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:00') AS start_time, strftime(ts, '%Y-%m-%d') AS date, "
        "strftime(ts, '%H:00') AS hour FROM events",
        "operator_slice": _with(_EV, _report("lte_operator"))
        + f"SELECT {_START} AS start_time, ne_name, cell_name, CASE cn_operator WHEN 'CN Operator ID=2' THEN 'B' ELSE 'A' END "
        "AS slice, l_traffic_user_avg_plmn, l_thrp_bits_dl_plmn FROM lte_operator "
        "WHERE cn_operator IN ('CN Operator ID=0', 'CN Operator ID=1', 'CN Operator ID=2')",
        "duplicate_keys": _with(_EV, _report("lte_daily1", all_kinds=True))
        + f"SELECT {_START} AS start_time, ne_name, cell_name, count(*) AS n_rows FROM lte_daily1 "
        "GROUP BY h, ne_name, cell_name HAVING count(*) > 1",
        "lte_report_join": _with(_lte_joined())
        + f"SELECT {_START} AS start_time, ne_name, cell_name, "
        + _partials(_LTE_ALL, ["l_traffic_user_avg", "l_cell_avail_dur"], _PRB)
        + ", count(*) AS joined_rows FROM j GROUP BY h, ne_name, cell_name",
        "umts_report_join": _umts_join_sql(),
        "first_last_snapshot": _with(_lte_joined())
        + "SELECT CASE WHEN h = (SELECT min(h) FROM j) THEN 'first' ELSE 'last' END AS moment, "
        f"{_START} AS start_time, ne_name, cell_name, count(*) AS joined_rows, sum(l_thrp_bits_dl) AS l_thrp_bits_dl, "
        "sum(l_uecntx_normrel) AS l_uecntx_normrel FROM j "
        "WHERE h = (SELECT min(h) FROM j) OR h = (SELECT max(h) FROM j) GROUP BY h, ne_name, cell_name",
        "cell_integrity": _with(_lte_joined(), _INTEGRITY) + "SELECT * FROM integrity",
        "lte_summary": _summary("lte"),
        "umts_summary": _summary("umts"),
        "lte_kpi_all_grains": _all_grains("lte"),
        "umts_kpi_all_grains": _all_grains("umts"),
        "csv_roundtrip": _with(_EV, _report("lte_operator"))
        + f"SELECT {_START} AS start_time, * EXCLUDE (h) FROM lte_operator",
        "csv_umts_roundtrip": _with(_EV, _report("umts_operator"))
        + f"SELECT {_START} AS start_time, * EXCLUDE (h) FROM umts_operator",
        "csv_lte_kpi_day": _with(_lte_joined(), _lte_network("k", "day")) + "SELECT * FROM k",
        "csv_awkward_roundtrip": _with(_EV, _report("lte_emtc", all_kinds=True))
        + f"SELECT {_START} AS start_time, * EXCLUDE (h) FROM lte_emtc",
        "csv_day_orders": _with(_EV, _report("lte_emtc", all_kinds=True))
        + f"SELECT {_START} AS start_time, * EXCLUDE (h) FROM lte_emtc",
        "csv_line_counts": _with(_EV, _report("lte_emtc", all_kinds=True))
        + "SELECT count(*) AS n_rows, 0 AS more_not_data, count(*) FILTER (right(ne_name, 1) = '3') AS without_time, "
        "count(*) FILTER (right(ne_name, 1) = '4') AS junk_cells FROM lte_emtc",
        "csv_rejects": _with(_EV, _report("lte_emtc", all_kinds=True))
        + "SELECT reason, count(*) AS n FROM (SELECT CASE right(ne_name, 1) WHEN '3' THEN 'start time' ELSE 'not a number' END AS reason "
        "FROM lte_emtc WHERE right(ne_name, 1) IN ('3', '4')) GROUP BY reason "
        "UNION ALL SELECT 'rows', count(*) FROM lte_emtc WHERE right(ne_name, 1) <> '3'",
        "csv_umts_kpi_day": _with(_umts_joined(), _umts_network("k", "day")) + "SELECT * FROM k",
        "lte_join_repeated_keys": _with(_few_names(_lte_joined()))
        + f"SELECT {_START} AS start_time, ne_name, cell_name, count(*) AS joined_rows, "
        "sum(l_thrp_bits_dl) AS l_thrp_bits_dl, count(l_cell_avail_dur) AS n_l_cell_avail_dur "
        "FROM j GROUP BY h, ne_name, cell_name",
        "lte_kpi_shared_names": _with(_few_names(_lte_joined()), _lte_network("k", "cell_hour")) + "SELECT * FROM k",
        "grain_sink_roundtrip": _sink(),
        "lte_sink_roundtrip": _sink_values("lte"),
        "umts_sink_roundtrip": _sink_values("umts"),
        "summary_sink_roundtrip": f"SELECT * FROM ({_summary('lte')}) UNION ALL SELECT * FROM ({_summary('umts')})",
        "sink_order": _sink_order(),
        "lte_report_by_day": _sink_values("lte"),
        "lte_summary_by_day": _summary("lte"),
        "umts_report_by_day": _sink_values("umts"),
    }
    for tech in ("lte", "umts"):  # what is left out before the sums has no partner anyway
        found[f"{tech}_join_drop_unmatched"] = found[f"{tech}_report_join"]
    for grain in _GRAINS:
        found[f"lte_kpi_{grain}"] = _with(_lte_joined(), _lte_network("k", grain)) + "SELECT * FROM k"
        found[f"umts_kpi_{grain}"] = _with(_umts_joined(), _umts_network("k", grain)) + "SELECT * FROM k"
        for s in "ab":
            found[f"lte_plmn_{grain}_{s}"] = (
                _with(_lte_joined(), _report("lte_operator"), _lte_operator("k", grain, s)) + "SELECT * FROM k"
            )
            found[f"umts_plmn_{grain}_{s}"] = (
                _with(_EV, _report("umts_operator"), _umts_operator("k", grain, s)) + "SELECT * FROM k"
            )
    return found

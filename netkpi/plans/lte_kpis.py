"""LTE: which aggregates are needed, and the 25 KPIs of the network and of one operator."""

from __future__ import annotations

from netkpi.operators.kpis import Kpi, ratio, total
from netkpi.operators.measures import Measures
from netkpi.sources import catalog

DAILY = Measures(
    sums=tuple(catalog.LTE_DAILY.columns),
    counts=("l_traffic_user_avg", "l_cell_avail_dur"),
    maxima=(
        "l_chmeas_prb_dl_avail",
        "l_chmeas_prb_ul_avail",
        "l_chmeas_prb_dl_drbused_avg",
        "l_chmeas_prb_ul_drbused_avg",
    ),
)
DAILY1 = Measures(sums=tuple(catalog.LTE_DAILY1.columns))
EMTC = Measures(sums=tuple(catalog.LTE_EMTC.columns))
NETWORK = DAILY + DAILY1 + EMTC

# Whole-cell aggregates that the KPIs of an operator read.
SHARED = Measures(
    sums=(
        "l_uecntx_abnormrel",
        "l_uecntx_normrel",
        "l_uecntx_rel_mme",
        "l_chmeas_prb_dl_avail",
        "l_chmeas_prb_ul_avail",
        "l_cell_avail_dur",
        "l_cell_unavail_dur_energysaving",
    ),
    counts=("l_cell_avail_dur",),
    maxima=("l_chmeas_prb_dl_avail", "l_chmeas_prb_ul_avail"),
)
OPERATOR = Measures(
    sums=tuple(catalog.LTE_OPERATOR.columns),
    counts=("l_traffic_user_avg_plmn",),
    maxima=("l_rbusedown_dl_plmn", "l_rbusedown_ul_plmn"),
)

GB_IN_BITS = 8 * 1024**3
RELEASED = total("l_uecntx_abnormrel", "l_uecntx_normrel") + " - l_uecntx_rel_mme"
AVAILABILITY = ratio(
    "100 * " + total("l_cell_avail_dur", "l_cell_unavail_dur_energysaving"), "n_l_cell_avail_dur * 3600"
)


def _success_rate(succeeded: list[str], attempted: list[str]) -> str:
    return ratio("100 * " + total(*succeeded), total(*attempted))


def _drop_rate(dropped: list[str], released: list[str]) -> str:
    """100 minus the share of dropped bearers."""
    return "100 - " + ratio("100 * " + total(*dropped), total(*released))


def _megabits(bits: str, last_bits: str, time: str) -> str:
    return ratio(f"({bits} - {last_bits})", f"{time} * 1000")


def _volumes(session: str, down: str, up: str, down_qci8: str, up_qci8: str) -> list[Kpi]:
    return [
        Kpi("VoLTE Traffic(Erls)", f"{session} / 36000"),
        Kpi("Traffic DL Volume (GB)", f"{down} / {GB_IN_BITS}"),
        Kpi("Traffic UL Volume (GB)", f"{up} / {GB_IN_BITS}"),
        Kpi("WBB traffic(GB)", f"{total(down_qci8, up_qci8)} / {GB_IN_BITS}"),
        Kpi("Total MOCN traffic (GB)", "traffic_dl_volume_gb + traffic_ul_volume_gb", of_kpis=True),
    ]


def _handovers(suffix: str) -> list[Kpi]:
    """Handover success; ``suffix`` picks the counters of the network or of an operator."""

    def out(scope: str, freq: str, step: str) -> str:
        return f"l_hho_{scope}_{freq}_{step}out{suffix}"

    def within(freq: str) -> str:
        scopes = ("intraenb", "interenb")
        return _success_rate(
            [out(s, freq, "execsucc") for s in scopes], [out(s, freq, "prepatt") for s in scopes]
        )

    def over_s1(step: str) -> str:
        """Handovers between base stations that did not go over X2."""
        inter_intra, x2_intra = out("interenb", "intrafreq", step), out("x2", "intrafreq", step)
        inter_inter, x2_inter = out("interenb", "interfreq", step), out("x2", "interfreq", step)
        return f"({inter_intra} - {x2_intra} + {inter_inter} - {x2_inter})"

    freqs = ("intrafreq", "interfreq")
    return [
        Kpi("HO Intra Success Rate (%)", within("intrafreq")),
        Kpi("HO Inter Success Rate (%)", within("interfreq")),
        Kpi(
            "HO X2 Success Rate (%)",
            _success_rate([out("x2", f, "execsucc") for f in freqs], [out("x2", f, "prepatt") for f in freqs]),
        ),
        Kpi("HO S1 Success Rate (%)", ratio("100 * " + over_s1("execsucc"), over_s1("prepatt"))),
    ]


def _redirection(redirected: str, for_csfb: str) -> Kpi:
    return Kpi("Redirection Rate (%)", ratio(f"100 * ({redirected} - {for_csfb})", f"({RELEASED})"))


NETWORK_KPIS = [
    *_volumes(
        "l_e_rab_sessiontime_highprecision_qci1",
        "l_thrp_bits_dl",
        "l_thrp_bits_ul",
        "l_thrp_bits_dl_qci_8",
        "l_thrp_bits_ul_qci_8",
    ),
    Kpi(
        "Accessibility PS (%)",
        " * ".join(
            [
                "100",
                ratio(
                    "(l_rrc_connreq_succ - l_rrc_connreq_succ_mosig)",
                    "(l_rrc_connreq_att - l_rrc_connreq_att_mosig)",
                ),
                ratio("l_s1sig_connest_succ", "l_s1sig_connest_att"),
                ratio("l_e_rab_succest", "l_e_rab_attest"),
            ]
        ),
    ),
    Kpi(
        "Accessibility Volte (%)",
        ratio("100 * l_e_rab_succest_qci_1", "(l_e_rab_attest_qci_1 - l_e_rab_failest_x2ap_voip)"),
    ),
    Kpi(
        "Retainability PS (%)",
        _drop_rate(
            ["l_e_rab_abnormrel"], ["l_e_rab_abnormrel", "l_e_rab_normrel", "l_e_rab_normrel_irathoout"]
        ),
    ),
    Kpi(
        "Retainability PS (%) (incl# MME)",
        _drop_rate(
            ["l_e_rab_abnormrel", "l_e_rab_abnormrel_mme"],
            ["l_e_rab_abnormrel", "l_e_rab_normrel", "l_e_rab_normrel_irathoout"],
        ),
    ),
    Kpi(
        "VoLTE Ret (%)",
        _drop_rate(
            ["l_e_rab_abnormrel_qci_1"],
            ["l_e_rab_abnormrel_qci_1", "l_e_rab_normrel_qci_1", "l_e_rab_normrel_irathoout_qci_1"],
        ),
    ),
    Kpi(
        "VoLTE Ret (%) (incl# MME)",
        _drop_rate(
            ["l_e_rab_abnormrel_qci_1", "l_e_rab_abnormrel_mme_voip"],
            ["l_e_rab_abnormrel_qci_1", "l_e_rab_normrel_qci_1", "l_e_rab_normrel_irathoout_qci_1"],
        ),
    ),
    Kpi(
        "Average DL Throughput(Mbps)",
        _megabits("l_thrp_bits_dl", "l_thrp_bits_dl_lasttti", "l_thrp_time_dl_rmvlasttti"),
    ),
    Kpi(
        "Average UL Throughput(Mbps)",
        _megabits("l_thrp_bits_ul", "l_thrp_bits_ue_ul_lasttti", "l_thrp_time_ue_ul_rmvlasttti"),
    ),
    *_handovers(""),
    Kpi("CSFB Success Rate(%)", ratio("100 * l_csfb_prepsucc", "l_csfb_prepatt")),
    _redirection("l_rrcredirection_e2w", "l_rrcredirection_e2w_csfb"),
    Kpi("Availability", AVAILABILITY),
    Kpi("PS Sim Users", "mean_l_traffic_user_avg"),
    Kpi("Average DL PRB Usage(%)", ratio("100 * l_chmeas_prb_dl_drbused_avg", "l_chmeas_prb_dl_avail")),
    Kpi(
        "Max DL PRB Usage(%)",
        ratio("100 * max_l_chmeas_prb_dl_drbused_avg", "max_l_chmeas_prb_dl_avail"),
        digits=0,
    ),
    Kpi("Average UL PRB Usage(%)", ratio("100 * l_chmeas_prb_ul_drbused_avg", "l_chmeas_prb_ul_avail")),
    Kpi("Max UL PRB Usage(%)", ratio("100 * max_l_chmeas_prb_ul_drbused_avg", "max_l_chmeas_prb_ul_avail")),
]

OPERATOR_KPIS = [
    *_volumes(
        "l_e_rab_sessiontime_highprecision_plmn_qci1",
        "l_thrp_bits_dl_plmn",
        "l_thrp_bits_ul_plmn",
        "l_thrp_bits_dl_plmn_qci_8",
        "l_thrp_bits_ul_plmn_qci_8",
    ),
    Kpi("Accessibility PS (%)", ratio("100 * l_e_rab_succest_plmn", "l_e_rab_attest_plmn")),
    Kpi("Accessibility Volte (%)", ratio("100 * l_e_rab_succest_plmn_qci_1", "l_e_rab_attest_plmn_qci_1")),
    Kpi(
        "Retainability PS (%)",
        _drop_rate(
            ["l_e_rab_abnormrel_plmn"],
            ["l_e_rab_abnormrel_plmn", "l_e_rab_normrel_plmn", "l_iratho_e2w_execsuccout_plmn"],
        ),
    ),
    Kpi(
        "Retainability PS (%) (incl# MME)",
        _drop_rate(
            ["l_e_rab_abnormrel_plmn", "l_e_rab_abnormrel_mme_plmn"],
            ["l_e_rab_abnormrel_plmn", "l_e_rab_normrel_plmn", "l_iratho_e2w_execsuccout_plmn"],
        ),
    ),
    Kpi(
        "VoLTE Ret (%)",
        _drop_rate(
            ["l_e_rab_abnormrel_plmn_qci_1"], ["l_e_rab_abnormrel_plmn_qci_1", "l_e_rab_normrel_plmn_qci_1"]
        ),
    ),
    Kpi(
        "VoLTE Ret (%) (incl# MME)",
        _drop_rate(
            ["l_e_rab_abnormrel_plmn_qci_1", "l_e_rab_abnormrel_mme_voip_plmn"],
            ["l_e_rab_abnormrel_plmn_qci_1", "l_e_rab_normrel_plmn_qci_1"],
        ),
    ),
    Kpi(
        "Average DL Throughput(Mbps)",
        _megabits("l_thrp_bits_dl_plmn", "l_thrp_bits_dl_lasttti_plmn", "l_thrp_time_dl_rmvlasttti_plmn"),
    ),
    Kpi(
        "Average UL Throughput(Mbps)",
        _megabits("l_thrp_bits_ul_plmn", "l_thrp_bits_ue_ul_lasttti_plmn", "l_thrp_time_ue_ul_rmvlasttti_plmn"),
    ),
    *_handovers("_plmn"),
    Kpi("CSFB Success Rate(%)", ratio("100 * l_csfb_prepsucc_plmn", "l_csfb_prepatt_plmn")),
    _redirection("l_rrcredirection_e2w_plmn", "l_rrcredirection_e2w_csfb_plmn"),
    Kpi("Availability", AVAILABILITY, note="has no operator part: both operators show the value of the cell"),
    Kpi("PS Sim Users", "mean_l_traffic_user_avg_plmn", note="mean over the rows of all PLMNs of the slice"),
    Kpi("Average DL PRB Usage(%)", ratio("100 * l_rbusedown_dl_plmn", "l_chmeas_prb_dl_avail")),
    Kpi(
        "Max DL PRB Usage(%)",
        ratio("100 * max_l_rbusedown_dl_plmn", "max_l_rbusedown_ul_plmn"),
        digits=0,
        note="divides by the uplink maximum, not by the available blocks",
    ),
    Kpi("Average UL PRB Usage(%)", ratio("100 * l_rbusedown_ul_plmn", "l_chmeas_prb_ul_avail")),
    Kpi("Max UL PRB Usage(%)", ratio("100 * max_l_rbusedown_ul_plmn", "max_l_chmeas_prb_ul_avail")),
]

# What the formulas read: some sums of the exports are in no KPI, and need not be joined and stored.
_FORMULAS = " ".join(k.sql for k in NETWORK_KPIS + OPERATOR_KPIS)
READ = tuple(m.reading(_FORMULAS) for m in (DAILY, DAILY1, EMTC))
NETWORK_READ = READ[0] + READ[1] + READ[2]
OPERATOR_READ = OPERATOR.reading(_FORMULAS)

# Rows of the before/after table as (section, label, KPI it shows).
SUMMARY_ROWS = [
    ("Traffic", "PS Sim Users", "PS Sim Users"),
    ("Traffic", "VoLTE Traffic(Erls)", "VoLTE Traffic(Erls)"),
    ("Traffic", "Traffic DL Volume (GB)", "Traffic DL Volume (GB)"),
    ("Traffic", "Traffic UL Volume (GB)", "Traffic UL Volume (GB)"),
    ("Traffic", "WBB traffic (GB)", "WBB traffic(GB)"),
    ("Traffic", "Total MOCN traffic (GB)", "Total MOCN traffic (GB)"),
    ("Accessibility", "Accessibility PS (%)", "Accessibility PS (%)"),
    ("Accessibility", "Accessibility VoLTE (%)", "Accessibility Volte (%)"),
    ("Retainability", "Retainability PS (%)", "Retainability PS (%)"),
    ("Retainability", "Retainability PS (%) (incl. MME)", "Retainability PS (%) (incl# MME)"),
    ("Retainability", "VoLTE Ret (%)", "VoLTE Ret (%)"),
    ("Retainability", "VoLTE Ret (%) (incl. MME)", "VoLTE Ret (%) (incl# MME)"),
    ("Integrity", "Throughput DL Average (Mbps)", "Average DL Throughput(Mbps)"),
    ("Integrity", "Throughput UL Average (Mbps)", "Average UL Throughput(Mbps)"),
    ("Integrity", "PRB Usage DL Average (%)", "Average DL PRB Usage(%)"),
    ("Integrity", "PRB Usage DL Max (%)", "Max DL PRB Usage(%)"),
    ("Integrity", "PRB Usage UL Average (%)", "Average UL PRB Usage(%)"),
    ("Integrity", "PRB Usage UL Max (%)", "Max UL PRB Usage(%)"),
    ("Integrity", "Cell Configuration Integrity", None),
    ("Mobility", "HO Intra Success Rate (%)", "HO Intra Success Rate (%)"),
    ("Mobility", "HO Inter Success Rate (%)", "HO Inter Success Rate (%)"),
    ("Mobility", "HO S1 Success Rate (%)", "HO S1 Success Rate (%)"),
    ("Mobility", "CSFB Success Rate (%)", "CSFB Success Rate(%)"),
    ("Mobility", "Redirection Rate (%)", "Redirection Rate (%)"),
    ("Availability", "Availability", "Availability"),
]

# Rows that also show the share of operator B, and rows without operator values.
SHARED_ROWS = [label for section, label, _ in SUMMARY_ROWS if section == "Traffic"]
NETWORK_ONLY_ROWS = ["Availability"]

"""UMTS: which aggregates are needed, and the KPIs of the network and of one operator.

Most counters are only ever used in a sum with others. Those sums are made per
row (*terms*), so that some 20 columns are grouped instead of 118.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netkpi.operators.kpis import Kpi, ratio, total
from netkpi.operators.measures import Measures
from netkpi.sources.catalog import BANDWIDTHS


def _ps_traffic(direction: str, streaming: tuple[int, ...]) -> list[str]:
    widths = {"bkg": BANDWIDTHS, "int": BANDWIDTHS, "str": streaming}
    bearers = [f"vs_ps_{s}_{direction}_{w}_traffic" for s, ws in widths.items() for w in ws]
    return [*bearers, f"vs_ps_conv_{direction}_traffic", f"vs_dcchsrb_{direction}_traffic"]


def _each(pattern: str, names: str) -> list[str]:
    return [pattern.format(n) for n in names.split()]


# Call causes; two of them are spelled differently in success and attempt counters.
_CAUSES_SUCCEEDED = """orgbkgcall tmbkgcall orgintercall tmitrcall orgstrcall tmstrcall orghhprsig tmhhprsig
    orglwprsig tmlwprsig orgsubcall unkown callreest"""
_CAUSES_ATTEMPTED = """orgbkgcall tmbkgcall orgintercall tmintercall orgstrcall tmstrcall orghhprsig tmhhprsig
    orglwprsig tmlwprsig orgsubcall unknown callreest"""
_VOICE = "orgconvcall tmconvcall emgcall"
_PACKET = "conv str int bkg"

DAILY_TERMS: dict[str, list[str]] = {
    "dl_bytes": ["vs_hsdpa_meanchthroughput_totalbytes", "vs_srnciubbytespsfach_tx", "vs_srnciubbytespsefach_tx"],
    "dl_bits": _ps_traffic("dl", BANDWIDTHS),
    "ul_bytes": ["vs_hsupa_meanchthroughput_totalbytes", "vs_srnciubbytespsrach_rx", "vs_srnciubbytespserach_rx"],
    "ul_bits": _ps_traffic("ul", BANDWIDTHS[:5]),
    "voice_rrc_succ": _each("rrc_succconnestab_{}", _VOICE),
    "voice_rrc_att": _each("rrc_attconnestab_{}", _VOICE),
    "voice_update_succ": _each("vs_succcellupdt_{}_pch", _VOICE),
    "voice_update_att": _each("vs_attcellupdt_{}_pch", _VOICE),
    "cs_rab_succ": _each("vs_rab_succestabcs_{}", "conv str"),
    "cs_rab_att": _each("vs_rab_attestabcs_{}", "conv str"),
    "ps_rrc_succ": _each("rrc_succconnestab_{}", _CAUSES_SUCCEEDED)
    + _each("vs_succcellupdt_{}", "pagersp uldatatrans"),
    "ps_rrc_att": _each("rrc_attconnestab_{}", _CAUSES_ATTEMPTED)
    + _each("vs_attcellupdt_{}", "pagersp uldatatrans"),
    "ps_rab_succ": _each("vs_rab_succestabps_{}", _PACKET),
}
DAILY1_TERMS: dict[str, list[str]] = {
    "ps_rab_att": _each("vs_rab_attestabps_{}", _PACKET),
}

_MEANS = ("vs_hsdpa_meanchthroughput", "vs_hsupa_meanchthroughput", "vs_celldchues")

DAILY = Measures(
    sums=(
        *DAILY_TERMS,
        "vs_amr_erlang_bestcell",
        "vs_vp_erlang_bestcell",
        *_MEANS,
        "vs_cell_unavailtime_sys",
    ),
    counts=(*_MEANS, "vs_cell_unavailtime_sys"),
)
DAILY1 = Measures(sums=(*DAILY1_TERMS, "vs_dccc_succ_f2d_afterp2f", "vs_dccc_att_f2d_afterp2f"))
NETWORK = DAILY + DAILY1


def with_terms(rows: DataFrame, terms: dict[str, list[str]]) -> DataFrame:
    """Add the sum of the counters of each term; a missing counter adds nothing."""

    def added(counters: list[str]):
        return F.expr(" + ".join(f"coalesce({c}, 0D)" for c in counters))

    return rows.withColumns({name: added(counters) for name, counters in terms.items()})


GB_IN_BYTES = 1024**3
GB_IN_BITS = 8 * 1024**3


def _volume(direction: str) -> str:
    return f"{direction}_bytes / {GB_IN_BYTES} + {direction}_bits / {GB_IN_BITS}"


_NOT_MEGABITS = "labelled Mbps, but the counter is in kbit/s"

NETWORK_KPIS = [
    Kpi("Voice Erlangs", total("vs_amr_erlang_bestcell", "vs_vp_erlang_bestcell") + " * 0.5D"),
    Kpi("Traffic DL Volume (GB)", _volume("dl")),
    Kpi("Traffic UL Volume (GB)", _volume("ul")),
    Kpi("Total MOCN Traffic(GB)", "traffic_ul_volume_gb + traffic_dl_volume_gb", digits=None, of_kpis=True),
    Kpi(
        "Accessibility CS (%)",
        " * ".join(
            [
                "100",
                ratio(total("voice_rrc_succ", "voice_update_succ"), total("voice_rrc_att", "voice_update_att")),
                ratio("cs_rab_succ", "cs_rab_att"),
            ]
        ),
    ),
    Kpi(
        "Accessibility PS (%)",
        " * ".join(
            [
                "100",
                ratio("(ps_rrc_succ - voice_update_succ)", "(ps_rrc_att - voice_update_att)"),
                ratio(
                    total("ps_rab_succ", "vs_dccc_succ_f2d_afterp2f"), total("ps_rab_att", "vs_dccc_att_f2d_afterp2f")
                ),
            ]
        ),
    ),
    Kpi("Average DL Throughput(Mbps)", "mean_vs_hsdpa_meanchthroughput", note=_NOT_MEGABITS),
    Kpi("Average UL Throughput(Mbps)", "mean_vs_hsupa_meanchthroughput", note=_NOT_MEGABITS),
    Kpi(
        "Availability",
        "100 - " + ratio("vs_cell_unavailtime_sys", "n_vs_cell_unavailtime_sys * 3600"),
        note="the lost share is not multiplied by 100",
    ),
    Kpi("PS Sim Users", "mean_vs_celldchues * 30 / 60"),
]

# PLMNs of the slices.
OPERATOR_PLMNS = {"A": (0, 1), "B": (2,)}
_OPERATOR_COUNTERS = ("vs_psload_dlthruput_mocn", "vs_psload_ulthruput_mocn", "vs_cs_erlang_equiv_mocn")
OPERATOR = Measures(
    sums=tuple(f"{c}_plmn{p}" for c in _OPERATOR_COUNTERS for plmns in OPERATOR_PLMNS.values() for p in plmns)
)


def operator_kpis(slice_name: str) -> list[Kpi]:
    down, up, voice = (total(*[f"{c}_plmn{p}" for p in OPERATOR_PLMNS[slice_name]]) for c in _OPERATOR_COUNTERS)
    bytes_by_8 = "a byte counter, divided by 8 all the same"
    return [
        Kpi("Traffic DL Volume (GB)", f"{down} / {GB_IN_BITS}", note=bytes_by_8),
        Kpi("Traffic UL Volume (GB)", f"{up} / {GB_IN_BITS}", note=bytes_by_8),
        Kpi("Voice Erlangs", f"{voice} * 0.5D"),
        Kpi("Total MOCN Traffic(GB)", "traffic_dl_volume_gb + traffic_ul_volume_gb", digits=None, of_kpis=True),
    ]


# Rows of the before/after table as (section, label, KPI it shows).
SUMMARY_ROWS = [
    ("Traffic", "PS Sim Users", "PS Sim Users"),
    ("Traffic", "Voice Erlangs", "Voice Erlangs"),
    ("Traffic", "Traffic DL Volume (GB)", "Traffic DL Volume (GB)"),
    ("Traffic", "Traffic UL Volume (GB)", "Traffic UL Volume (GB)"),
    ("Traffic", "Total MOCN Traffic(GB)", "Total MOCN Traffic(GB)"),
    ("Accessibility", "Accessibility CS (%)", "Accessibility CS (%)"),
    ("Accessibility", "Accessibility PS (%)", "Accessibility PS (%)"),
    ("Integrity", "Throughput DL Average (Mbps)", "Average DL Throughput(Mbps)"),
    ("Integrity", "Throughput UL Average (Mbps)", "Average UL Throughput(Mbps)"),
    ("Availability", "Availability", "Availability"),
]

SHARED_ROWS = ["Voice Erlangs", "Traffic DL Volume (GB)", "Traffic UL Volume (GB)", "Total MOCN Traffic(GB)"]
NETWORK_ONLY_ROWS = [label for _, label, _ in SUMMARY_ROWS if label not in SHARED_ROWS]

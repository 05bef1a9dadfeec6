"""KPI values worked out by hand."""

from __future__ import annotations

import pytest

from netkpi.operators.snapshots import cell_integrity
from netkpi.plans import lte, umts
from netkpi.sources import catalog
from tests.helpers import clean_frame, hour

GB = 1024**3
D1, D2 = hour("2021-01-29 13:00"), hour("2021-01-30 14:00")
A1 = {"hour_ts": D1, "ne_name": "N", "cell_name": "CA"}
B1 = {"hour_ts": D1, "ne_name": "N", "cell_name": "CB"}
A2 = {"hour_ts": D2, "ne_name": "N", "cell_name": "CA"}


@pytest.fixture(scope="module")
def lte_frames(spark):
    daily = clean_frame(
        spark,
        catalog.LTE_DAILY,
        [
            {
                **A1,
                "l_traffic_user_avg": 10.0,
                "l_thrp_bits_dl": 8.0 * GB,
                "l_thrp_bits_ul": 4.0 * GB,
                "l_thrp_bits_dl_lasttti": 2.0 * GB,
                "l_thrp_time_dl_rmvlasttti": 6.0 * GB / 5000,
                "l_rrc_connreq_succ": 90.0,
                "l_rrc_connreq_succ_mosig": 10.0,
                "l_rrc_connreq_att": 110.0,
                "l_rrc_connreq_att_mosig": 10.0,
                "l_s1sig_connest_succ": 1.0,
                "l_s1sig_connest_att": 2.0,
                "l_e_rab_succest": 3.0,
                "l_e_rab_attest": 4.0,
                "l_e_rab_abnormrel": 1.0,
                "l_e_rab_abnormrel_mme": 2.0,
                "l_e_rab_normrel": 6.0,
                "l_e_rab_normrel_irathoout": 1.0,
                "l_e_rab_sessiontime_highprecision_qci1": 36_000.0,
                "l_cell_avail_dur": 3600.0,
                "l_chmeas_prb_dl_drbused_avg": 25.0,
                "l_chmeas_prb_dl_avail": 100.0,
                "l_hho_interenb_intrafreq_execsuccout": 9.0,
                "l_hho_interenb_intrafreq_prepattout": 12.0,
                "l_rrcredirection_e2w": 5.0,
                "l_rrcredirection_e2w_csfb": 3.0,
            },
            {
                **B1,
                "l_traffic_user_avg": None,
                "l_thrp_bits_dl": 8.0 * GB,
                "l_cell_avail_dur": 1800.0,
                "l_chmeas_prb_dl_drbused_avg": 50.0,
                "l_chmeas_prb_dl_avail": 80.0,
                "l_s1sig_connest_att": 2.0,
            },
            {**A2, "l_traffic_user_avg": 3.0, "l_cell_avail_dur": None, "l_thrp_bits_dl": None},
        ],
    )
    daily1 = clean_frame(
        spark,
        catalog.LTE_DAILY1,
        [
            {
                **A1,
                "l_uecntx_abnormrel": 4.0,
                "l_uecntx_normrel": 8.0,
                "l_uecntx_rel_mme": 2.0,
                "l_hho_x2_intrafreq_execsuccout": 1.0,
                "l_hho_x2_intrafreq_prepattout": 2.0,
            },
            B1,
            A2,
        ],
    )
    emtc = clean_frame(spark, catalog.LTE_EMTC, [A1, B1, A2])

    def of(plmn, **counters):
        return {**A1, "cn_operator": f"CN Operator ID={plmn}", **counters}

    operator = clean_frame(
        spark,
        catalog.LTE_OPERATOR,
        [
            of(0, l_traffic_user_avg_plmn=4.0, l_thrp_bits_dl_plmn=8.0 * GB, l_rbusedown_dl_plmn=10.0, l_rbusedown_ul_plmn=4.0),
            of(1, l_traffic_user_avg_plmn=6.0, l_thrp_bits_dl_plmn=16.0 * GB, l_rbusedown_dl_plmn=30.0, l_rbusedown_ul_plmn=8.0),
            of(
                2,
                l_traffic_user_avg_plmn=5.0,
                l_thrp_bits_dl_plmn=8.0 * GB,
                l_rrcredirection_e2w_plmn=6.0,
                l_e_rab_abnormrel_plmn=1.0,
                l_e_rab_normrel_plmn=2.0,
                l_iratho_e2w_execsuccout_plmn=1.0,
            ),
            of(3, l_traffic_user_avg_plmn=99.0, l_thrp_bits_dl_plmn=800.0 * GB),
            {**A2, "cn_operator": "CN Operator ID=0", "l_traffic_user_avg_plmn": 7.0},
        ],
    )
    return daily, daily1, emtc, operator


def test_lte_network_day(lte_frames):
    first, second = lte.network_table(lte.cells(*lte_frames[:3]), "day").orderBy("date").collect()
    assert first.date == "2021-01-29"
    assert first.volte_traffic_erls == 1.0
    assert first.traffic_dl_volume_gb == 2.0
    assert first.traffic_ul_volume_gb == 0.5
    assert first.total_mocn_traffic_gb == 2.5
    assert first.accessibility_ps_pct == 15.0  # 80/100 * 1/4 * 3/4
    assert first.retainability_ps_pct == 87.5
    assert first.retainability_ps_pct_incl_mme == 62.5
    assert first.average_dl_throughput_mbps == 11.67  # (16 - 2) GB over 1.2 million s
    assert first.average_ul_throughput_mbps is None  # no time: division by zero
    assert first.ho_s1_success_rate_pct == 80.0  # (9 - 1) / (12 - 2)
    assert first.ho_x2_success_rate_pct == 50.0
    assert first.ho_intra_success_rate_pct == 75.0
    assert first.ho_inter_success_rate_pct is None
    assert first.redirection_rate_pct == 20.0
    assert first.availability == 75.0
    assert first.ps_sim_users == 10.0  # the missing value does not count
    assert first.average_dl_prb_usage_pct == 41.67
    assert first.max_dl_prb_usage_pct == 50.0
    assert second.traffic_dl_volume_gb == 0.0  # nothing but missing values sums up to 0
    assert second.availability is None
    assert second.ps_sim_users == 3.0


def test_lte_cell_grain(lte_frames):
    rows = lte.network_table(lte.cells(*lte_frames[:3]), "cell").orderBy("date", "cell_name").collect()
    assert [(r.date, r.ne_name, r.cell_name, r.availability) for r in rows] == [
        ("2021-01-29", "N", "CA", 100.0),
        ("2021-01-29", "N", "CB", 50.0),
        ("2021-01-30", "N", "CA", None),
    ]


def test_lte_operators(lte_frames):
    *network, operator = lte_frames
    cells = lte.cells(*network)
    a, a_next = lte.operator_table(cells, operator, "day", "A").orderBy("date").collect()
    assert a.traffic_dl_volume_gb == 3.0
    assert a.ps_sim_users == 5.0  # mean over the rows of PLMN 0 and 1
    assert a.max_dl_prb_usage_pct == 375.0  # 30 / 8
    assert a.average_dl_prb_usage_pct == 22.22  # 40 / 180
    assert a.availability == 75.0
    assert a_next.ps_sim_users == 7.0
    [b] = lte.operator_table(cells, operator, "day", "B").collect()
    assert b.traffic_dl_volume_gb == 1.0
    assert b.retainability_ps_pct == 75.0
    assert b.redirection_rate_pct == 60.0  # 6 / (4 + 8 - 2)
    [cell_hour] = lte.operator_table(cells, operator, "cell_hour", "B").collect()
    assert (cell_hour.date, cell_hour.hour, cell_hour.cell_name) == ("2021-01-29", "13:00", "CA")


def test_lte_summary(lte_frames):
    *network, operator = lte_frames
    cells = lte.cells(*network)
    rows = {r.kpi: r for r in lte.summary(cell_integrity(cells), lte.day_tables(cells, operator)).collect()}
    assert len(rows) == 25
    users = rows["PS Sim Users"]
    # every slice has its own last day: B ends a day before A
    assert (users.before_all, users.after_all, users.after_a, users.after_b) == (10.0, 3.0, 7.0, 5.0)
    assert users.share_b == 5.0 / 12.0
    assert users.after_date == "2021-01-30"
    cells_row = rows["Cell Configuration Integrity"]
    assert (cells_row.before_all, cells_row.after_all, cells_row.after_a, cells_row.after_b) == (2.0, 1.0, 1.0, 1.0)
    availability = rows["Availability"]
    assert (availability.before_all, availability.after_a, availability.after_b) == (75.0, None, None)
    assert rows["Accessibility PS (%)"].share_b is None
    assert [r.position for r in rows.values()] == list(range(1, 26))


def test_summary_of_an_empty_slice(lte_frames):
    *network, operator = lte_frames
    cells = lte.cells(*network)
    nothing = operator.filter("cn_operator <> 'CN Operator ID=2'")
    rows = lte.summary(cell_integrity(cells), lte.day_tables(cells, nothing)).collect()
    assert len(rows) == 25
    assert {r.after_b for r in rows if r.kpi != "Cell Configuration Integrity"} == {None}


U1 = {"hour_ts": D1, "site": "S1", "cell": "S1_1", "cell_id": "1"}
U2 = {"hour_ts": D1, "site": "S1", "cell": "S1_2", "cell_id": None}


@pytest.fixture(scope="module")
def umts_frames(spark):
    daily = clean_frame(
        spark,
        catalog.UMTS_DAILY,
        [
            {
                **U1,
                "vs_amr_erlang_bestcell": 3.0,
                "vs_vp_erlang_bestcell": 1.0,
                "vs_hsdpa_meanchthroughput_totalbytes": 1.0 * GB,
                "vs_ps_bkg_dl_8_traffic": 4.0 * GB,
                "vs_ps_str_dl_384_traffic": 4.0 * GB,
                "vs_dcchsrb_dl_traffic": None,
                "vs_ps_conv_ul_traffic": 4.0 * GB,
                "rrc_succconnestab_orgconvcall": 6.0,
                "vs_succcellupdt_emgcall_pch": 2.0,
                "rrc_attconnestab_tmconvcall": 10.0,
                "vs_attcellupdt_emgcall_pch": 6.0,
                "vs_rab_succestabcs_conv": 1.0,
                "vs_rab_attestabcs_str": 2.0,
                "rrc_succconnestab_unkown": 5.0,
                "vs_succcellupdt_uldatatrans": 7.0,
                "rrc_attconnestab_unknown": 26.0,
                "vs_rab_succestabps_int": 2.0,
                "vs_hsdpa_meanchthroughput": 100.0,
                "vs_hsupa_meanchthroughput": None,
                "vs_cell_unavailtime_sys": 360.0,
                "vs_celldchues": 8.0,
            },
            {**U2, "vs_hsdpa_meanchthroughput": 50.0, "vs_hsupa_meanchthroughput": 7.0, "vs_cell_unavailtime_sys": None},
        ],
    )
    daily1 = clean_frame(
        spark,
        catalog.UMTS_DAILY1,
        [{**U1, "vs_dccc_succ_f2d_afterp2f": 2.0, "vs_rab_attestabps_bkg": 3.0, "vs_dccc_att_f2d_afterp2f": 2.0}, U2],
    )
    operator = clean_frame(
        spark,
        catalog.UMTS_OPERATOR,
        [
            {
                **U1,
                "vs_psload_dlthruput_mocn_plmn0": 8.0 * GB,
                "vs_psload_dlthruput_mocn_plmn1": 16.0 * GB,
                "vs_psload_dlthruput_mocn_plmn2": 8.0 * GB,
                "vs_psload_dlthruput_mocn_plmn3": 800.0 * GB,
                "vs_psload_ulthruput_mocn_plmn2": 4.0 * GB,
                "vs_cs_erlang_equiv_mocn_plmn0": 5.0,
            }
        ],
    )
    return daily, daily1, operator


def test_umts_network_day(umts_frames):
    [r] = umts.network_table(umts.cells(*umts_frames[:2]), "day").collect()
    assert r.voice_erlangs == 2.0
    assert r.traffic_dl_volume_gb == 2.0
    assert r.traffic_ul_volume_gb == 0.5
    assert r.total_mocn_traffic_gb == 2.5
    assert r.accessibility_cs_pct == 25.0  # 8/16 * 1/2
    assert r.accessibility_ps_pct == 40.0  # (12 - 2)/(26 - 6) * 4/5
    assert r.average_dl_throughput_mbps == 75.0
    assert r.average_ul_throughput_mbps == 7.0
    assert r.availability == 99.9  # 360 / (1 * 3600), not times 100
    assert r.ps_sim_users == 2.0


def test_umts_cells_without_id_are_left_out_of_cell_grains(umts_frames):
    cells = umts.cells(*umts_frames[:2])
    assert [r.cell for r in umts.network_table(cells, "cell").collect()] == ["S1_1"]
    assert [r.cell for r in umts.network_table(cells, "cell_hour").collect()] == ["S1_1"]


def test_umts_operators_and_summary(umts_frames):
    *network, operator = umts_frames
    [a] = umts.operator_table(operator, "day", "A").collect()
    assert (a.traffic_dl_volume_gb, a.traffic_ul_volume_gb, a.voice_erlangs, a.total_mocn_traffic_gb) == (3.0, 0.0, 2.5, 3.0)
    [b] = umts.operator_table(operator, "day", "B").collect()
    assert (b.traffic_dl_volume_gb, b.traffic_ul_volume_gb, b.voice_erlangs, b.total_mocn_traffic_gb) == (1.0, 0.5, 0.0, 1.5)
    rows = {r.kpi: r for r in umts.summary(umts.day_tables(umts.cells(*network), operator)).collect()}
    assert len(rows) == 10
    down = rows["Traffic DL Volume (GB)"]
    assert (down.before_all, down.after_all, down.after_a, down.after_b, down.share_b) == (2.0, 2.0, 3.0, 1.0, 0.25)
    assert rows["PS Sim Users"].after_a is None
    assert rows["PS Sim Users"].share_b is None

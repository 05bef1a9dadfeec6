"""Counters of the seven report files.

A counter is written ``name`` or ``name [unit]``; a missing unit is ``None``.
The CSV header carries ``name (unit)``; inside the engine a counter is a
``DOUBLE`` column named after it in snake case.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

BANDWIDTHS = (8, 16, 32, 64, 128, 144, 256, 384)

# The counters of each report, in the order of the export.
_LTE_DAILY = """
L.Traffic.User.Avg
L.Thrp.bits.DL [bit]
L.Thrp.bits.DL.SRB [bit]
L.Thrp.bits.UL.SRB [bit]
L.Thrp.bits.UL [bit]
L.Thrp.bits.DL.LastTTI [bit]
L.Thrp.Time.DL.RmvLastTTI [ms]
L.Thrp.Time.UE.UL.RmvLastTTI [ms]
L.Thrp.bits.UE.UL.LastTTI [bit]
L.ChMeas.PRB.DL.DrbUsed.Avg
L.ChMeas.PRB.DL.Avail
L.RRC.ConnReq.Succ
L.RRC.ConnReq.Succ.MoSig
L.RRC.ConnReq.Att
L.RRC.ConnReq.Att.MoSig
L.S1Sig.ConnEst.Succ
L.S1Sig.ConnEst.Att
L.E-RAB.SuccEst
L.E-RAB.AttEst
L.E-RAB.AbnormRel
L.E-RAB.AbnormRel.MME
L.E-RAB.NormRel.IRatHOOut
L.E-RAB.NormRel
L.HHO.IntraeNB.IntraFreq.ExecSuccOut
L.HHO.IntereNB.IntraFreq.ExecSuccOut
L.HHO.IntraeNB.IntraFreq.ExecAttOut
L.HHO.IntereNB.IntraFreq.ExecAttOut
L.CSFB.PrepSucc
L.CSFB.PrepAtt
L.E-RAB.SuccEst.QCI.1
L.E-RAB.AttEst.QCI.1
L.E-RAB.FailEst.X2AP.VoIP
L.E-RAB.AbnormRel.QCI.1
L.E-RAB.AbnormRel.MME.VoIP
L.E-RAB.NormRel.QCI.1
L.E-RAB.NormRel.IRatHOOut.QCI.1
L.E-RAB.SessionTime.HighPrecision.QCI1 [100 ms]
L.Cell.Avail.Dur [s]
L.Cell.Unavail.Dur.EnergySaving [s]
L.Thrp.bits.DL.QCI.8 [bit]
L.Thrp.bits.UL.QCI.8 [bit]
L.ChMeas.PRB.UL.DrbUsed.Avg
L.ChMeas.PRB.UL.Avail
L.HHO.IntraeNB.IntraFreq.PrepAttOut
L.HHO.IntereNB.IntraFreq.PrepAttOut
L.HHO.IntraeNB.InterFreq.ExecSuccOut
L.HHO.IntereNB.InterFreq.ExecSuccOut
L.HHO.IntraeNB.InterFreq.PrepAttOut
L.HHO.IntereNB.InterFreq.PrepAttOut
L.RRCRedirection.E2W
L.RRCRedirection.E2W.CSFB
"""

_LTE_DAILY1 = """
L.UECNTX.AbnormRel
L.UECNTX.NormRel
L.UECNTX.Rel.MME
L.HHO.X2.IntraFreq.ExecSuccOut
L.HHO.X2.InterFreq.ExecSuccOut
L.HHO.X2.IntraFreq.PrepAttOut
L.HHO.X2.InterFreq.PrepAttOut
"""

_LTE_EMTC = """
L.Thrp.eMTC.bits.DL [bit]
L.Thrp.eMTC.bits.UL [bit]
"""

_LTE_OPERATOR = """
L.Traffic.User.Avg.PLMN
L.Thrp.bits.DL.PLMN [bit]
L.Thrp.bits.UL.PLMN [bit]
L.Thrp.bits.DL.LastTTI.PLMN [bit]
L.Thrp.Time.DL.RmvLastTTI.PLMN [ms]
L.Thrp.bits.UE.UL.LastTTI.PLMN [bit]
L.Thrp.Time.UE.UL.RmvLastTTI.PLMN [ms]
L.RBUsedOwn.DL.PLMN
L.E-RAB.SuccEst.PLMN
L.E-RAB.AttEst.PLMN
L.E-RAB.AbnormRel.PLMN
L.E-RAB.AbnormRel.MME.PLMN
L.E-RAB.NormRel.PLMN
L.IRATHO.E2W.ExecSuccOut.PLMN
L.IRATHO.E2G.ExecSuccOut.PLMN
L.HHO.IntraeNB.IntraFreq.ExecSuccOut.PLMN
L.HHO.IntereNB.IntraFreq.ExecSuccOut.PLMN
L.HHO.IntraeNB.IntraFreq.ExecAttOut.PLMN
L.HHO.IntereNB.IntraFreq.ExecAttOut.PLMN
L.CSFB.PrepSucc.PLMN
L.CSFB.PrepAtt.PLMN
L.E-RAB.SuccEst.PLMN.QCI.1
L.E-RAB.AttEst.PLMN.QCI.1
L.E-RAB.AbnormRel.PLMN.QCI.1
L.E-RAB.AbnormRel.MME.VoIP.PLMN
L.E-RAB.NormRel.PLMN.QCI.1
L.E-RAB.SessionTime.HighPrecision.PLMN.QCI1 [100 ms]
L.Thrp.bits.DL.PLMN.QCI.8 [bit]
L.Thrp.bits.UL.PLMN.QCI.8 [bit]
L.RBUsedOwn.UL.PLMN
L.HHO.IntraeNB.IntraFreq.PrepAttOut.PLMN
L.HHO.IntereNB.IntraFreq.PrepAttOut.PLMN
L.HHO.IntraeNB.InterFreq.ExecSuccOut.PLMN
L.HHO.IntereNB.InterFreq.ExecSuccOut.PLMN
L.HHO.IntraeNB.InterFreq.PrepAttOut.PLMN
L.HHO.IntereNB.InterFreq.PrepAttOut.PLMN
L.HHO.X2.IntraFreq.ExecSuccOut.PLMN
L.HHO.X2.InterFreq.ExecSuccOut.PLMN
L.HHO.X2.IntraFreq.PrepAttOut.PLMN
L.HHO.X2.InterFreq.PrepAttOut.PLMN
L.RRCRedirection.E2W.PLMN
L.RRCRedirection.E2W.CSFB.PLMN
"""


def ps_traffic(service: str, direction: str, widths: tuple[int, ...] = BANDWIDTHS) -> list[str]:
    """Packet traffic counters of one service class, one per bearer width."""
    return [f"VS.PS.{service}.{direction}.{w}.Traffic [bit]" for w in widths]


_UMTS_DAILY = "\n".join(
    [
        "VS.HSDPA.MeanChThroughput.TotalBytes [byte]",
        *ps_traffic("Bkg", "DL"),
        *ps_traffic("Int", "DL"),
        *ps_traffic("Str", "DL"),
        "VS.PS.Conv.DL.Traffic [bit]",
        "VS.HSUPA.MeanChThroughput.TotalBytes [byte]",
        *ps_traffic("Bkg", "UL"),
        *ps_traffic("Int", "UL"),
        *ps_traffic("Str", "UL", BANDWIDTHS[:5]),
        "VS.PS.Conv.UL.Traffic [bit]",
        # The other counters of the report.
        """
VS.HSDPA.UE.Mean.Cell
VS.AMR.Erlang.BestCell
VS.HSDPA.MeanChThroughput [kbit/s]
VS.HSUPA.MeanChThroughput [kbit/s]
VS.Cell.UnavailTime.Sys [s]
VS.CellDCHUEs
VS.VP.Erlang.BestCell
VS.SRNCIubBytesPSFACH.Tx [byte]
VS.SRNCIubBytesPSEFACH.Tx [byte]
VS.DcchSRB.Dl.Traffic [bit]
VS.SRNCIubBytesPSRACH.Rx [byte]
VS.SRNCIubBytesPSERACH.Rx [byte]
VS.DcchSRB.Ul.Traffic [bit]
RRC.SuccConnEstab.OrgConvCall
RRC.SuccConnEstab.TmConvCall
RRC.SuccConnEstab.EmgCall
VS.SuccCellUpdt.OrgConvCall.PCH
VS.SuccCellUpdt.TmConvCall.PCH
VS.SuccCellUpdt.EmgCall.PCH
RRC.AttConnEstab.OrgConvCall
RRC.AttConnEstab.TmConvCall
RRC.AttConnEstab.EmgCall
VS.AttCellUpdt.OrgConvCall.PCH
VS.AttCellUpdt.TmConvCall.PCH
VS.AttCellUpdt.EmgCall.PCH
VS.RAB.SuccEstabCS.Conv
VS.RAB.SuccEstabCS.Str
VS.RAB.AttEstabCS.Conv
VS.RAB.AttEstabCS.Str
RRC.SuccConnEstab.OrgBkgCall
RRC.SuccConnEstab.TmBkgCall
RRC.SuccConnEstab.OrgInterCall
RRC.SuccConnEstab.TmItrCall
RRC.SuccConnEstab.OrgStrCall
RRC.SuccConnEstab.TmStrCall
RRC.SuccConnEstab.OrgHhPrSig
RRC.SuccConnEstab.TmHhPrSig
RRC.SuccConnEstab.OrgLwPrSig
RRC.SuccConnEstab.TmLwPrSig
RRC.SuccConnEstab.OrgSubCall
RRC.SuccConnEstab.Unkown
RRC.SuccConnEstab.CallReEst
VS.SuccCellUpdt.PageRsp
VS.SuccCellUpdt.ULDataTrans
RRC.AttConnEstab.OrgBkgCall
RRC.AttConnEstab.TmBkgCall
RRC.AttConnEstab.OrgInterCall
RRC.AttConnEstab.TmInterCall
RRC.AttConnEstab.OrgStrCall
RRC.AttConnEstab.TmStrCall
RRC.AttConnEstab.OrgHhPrSig
RRC.AttConnEstab.TmHhPrSig
RRC.AttConnEstab.OrgLwPrSig
RRC.AttConnEstab.TmLwPrSig
RRC.AttConnEstab.OrgSubCall
RRC.AttConnEstab.Unknown
RRC.AttConnEstab.CallReEst
VS.AttCellUpdt.PageRsp
VS.AttCellUpdt.ULDataTrans
VS.RAB.SuccEstabPS.Conv
VS.RAB.SuccEstabPS.Str
VS.RAB.SuccEstabPS.Int
VS.RAB.SuccEstabPS.Bkg
""",
    ]
)

_UMTS_DAILY1 = """
VS.DCCC.Succ.F2D.AfterP2F
VS.RAB.AttEstabPS.Conv
VS.RAB.AttEstabPS.Str
VS.RAB.AttEstabPS.Int
VS.RAB.AttEstabPS.Bkg
VS.DCCC.Att.F2D.AfterP2F
"""

_UMTS_OPERATOR = "\n".join(
    f"VS.{name}.MOCN.PLMN{plmn} [{unit}]"
    for name, unit in (("PSLoad.ULThruput", "byte"), ("PSLoad.DLThruput", "byte"), ("CS.Erlang.Equiv", "Erl"))
    for plmn in range(4)
)


def snake(name: str) -> str:
    """``L.E-RAB.AttEst`` -> ``l_e_rab_attest``."""
    return re.sub(r"[^0-9a-z]+", "_", name.lower()).strip("_")


@dataclass(frozen=True)
class Counter:
    name: str
    unit: str

    @property
    def label(self) -> str:
        """Name of the counter in the CSV header."""
        return f"{self.name} ({self.unit})"

    @property
    def column(self) -> str:
        return snake(self.name)


@dataclass(frozen=True)
class Report:
    """One kind of export file: its key columns and its counters."""

    name: str
    tech: str
    counters: tuple[Counter, ...]
    per_operator_rows: bool = False

    @property
    def keys(self) -> tuple[str, ...]:
        return KEYS[self.tech]

    @property
    def columns(self) -> list[str]:
        return [c.column for c in self.counters]


KEYS = {"lte": ("ne_name", "cell_name"), "umts": ("site", "cell", "cell_id")}


def _counters(text: str) -> tuple[Counter, ...]:
    found = []
    for line in text.split("\n"):
        if line.strip():
            name, _, unit = line.strip().partition(" [")
            found.append(Counter(name, unit.rstrip("]") or "None"))
    return tuple(found)


LTE_DAILY = Report("lte_daily", "lte", _counters(_LTE_DAILY))
LTE_DAILY1 = Report("lte_daily1", "lte", _counters(_LTE_DAILY1))
LTE_EMTC = Report("lte_emtc", "lte", _counters(_LTE_EMTC))
LTE_OPERATOR = Report("lte_operator", "lte", _counters(_LTE_OPERATOR), per_operator_rows=True)
UMTS_DAILY = Report("umts_daily", "umts", _counters(_UMTS_DAILY))
UMTS_DAILY1 = Report("umts_daily1", "umts", _counters(_UMTS_DAILY1))
UMTS_OPERATOR = Report("umts_operator", "umts", _counters(_UMTS_OPERATOR))

REPORTS = {
    r.name: r
    for r in (LTE_DAILY, LTE_DAILY1, LTE_EMTC, LTE_OPERATOR, UMTS_DAILY, UMTS_DAILY1, UMTS_OPERATOR)
}

# Counters no KPI reads: a file may lack them.
UNUSED = {
    "VS.HSDPA.UE.Mean.Cell",
    "VS.PSLoad.ULThruput.MOCN.PLMN3",
    "VS.PSLoad.DLThruput.MOCN.PLMN3",
    "VS.CS.Erlang.Equiv.MOCN.PLMN3",
}

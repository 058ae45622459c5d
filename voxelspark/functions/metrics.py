"""Evaluation metrics as SQL expressions over one aggregate per subject and label.

Counts tp, tn, fp, fn and n are doubles, so squares don't overflow; every division has its edge case before it.
"""

from __future__ import annotations

NAN, INF, NEG = "CAST('NaN' AS DOUBLE)", "CAST('Infinity' AS DOUBLE)", "CAST('-Infinity' AS DOUBLE)"


def _ratio(top: str, bottom: str, empty: str) -> str:
    return f"CASE WHEN {bottom} = 0 THEN {empty} ELSE ({top}) / ({bottom}) END"


_N = "(tp+tn+fp+fn)"
_CHANCE = f"(((tn+fn)*(tn+fp)+(fp+tp)*(fn+tp))/{_N})"
_NIS, _NJS = "((tn+fn)*(tn+fn)+(fp+tp)*(fp+tp))", "((tn+fp)*(tn+fp)+(fn+tp)*(fn+tp))"
_S2 = "(tp*tp+tn*tn+fp*fp+fn*fn)"
#: Pairs of voxels: together in both, in the reference alone, in the prediction alone, in neither.
_A = "((tp*(tp-1)+tn*(tn-1)+fp*(fp-1)+fn*(fn-1))/2)"
_B, _C = f"(({_NJS}-{_S2})/2)", f"(({_NIS}-{_S2})/2)"
_D = f"(({_N}*{_N}+{_S2}-{_NIS}-{_NJS})/2)"
_PAIRS = f"({_A}+{_B}+{_C}+{_D})"


def _plogp(cell: str) -> str:
    return f"(CASE WHEN {cell} = 0 THEN 0.0 ELSE -({cell})/{_N}*log2(({cell})/{_N}) END)"


_H1 = f"({_plogp('(tp+fn)')}+{_plogp('(tn+fp)')})"
_H2 = f"({_plogp('(tp+fp)')}+{_plogp('(tn+fn)')})"
_H12 = f"({_plogp('tp')}+{_plogp('tn')}+{_plogp('fp')}+{_plogp('fn')})"
_ONE_SIDED = f"(tp+fn = 0 OR tp+fp = 0 OR tp+fn = {_N} OR tp+fp = {_N})"
_E1 = f"((fn*(fn+2*tp)/(tp+fn)+fp*(fp+2*tn)/(tn+fp))/{_N})"
_E2 = f"((fp*(fp+2*tp)/(tp+fp)+fn*(fn+2*tn)/(tn+fn))/{_N})"
_EXPECTED = f"(({_A}+{_C})*({_A}+{_B})/{_PAIRS})"


def f_measure(beta: float = 1.0) -> str:
    b2 = beta * beta
    # (1+b2) P R / (b2 P + R) with P and R put in, so that only their own edge cases remain.
    return f"CASE WHEN tp+fn = 0 THEN {NAN} WHEN tp = 0 THEN 0.0 ELSE {1 + b2}*tp/({1 + b2}*tp+{b2}*fn+fp) END"


OVERLAP = {
    "DICE": _ratio("2*tp", "(2*tp+fp+fn)", "1.0"),
    "JACRD": _ratio("tp", "(tp+fp+fn)", "1.0"),
    "ADJRIND": f"CASE WHEN {_PAIRS} = 0 THEN 0.0 WHEN (({_A}+{_C})+({_A}+{_B}))/2 - {_EXPECTED} = 0 THEN 0.0 ELSE ({_A}-{_EXPECTED})/((({_A}+{_C})+({_A}+{_B}))/2-{_EXPECTED}) END",
    "AUC": f"CASE WHEN tp+fn = 0 THEN {NEG} WHEN tn+fp = 0 THEN {NAN} ELSE (tp/(tp+fn)-fp/(tn+fp)+1)/2 END",
    "KAPPA": f"CASE WHEN {_N} = 0 OR {_N} = {_CHANCE} THEN {NEG} ELSE (tp+tn-{_CHANCE})/({_N}-{_CHANCE}) END",
    "RNDIND": _ratio(f"{_A}+{_D}", _PAIRS, NAN),
    "VOLSMTY": f"CASE WHEN tp+fn+fp = 0 THEN {NEG} ELSE 1-abs(fn-fp)/(2*tp+fn+fp) END",
    "MUTINF": f"CASE WHEN {_ONE_SIDED} THEN {NEG} ELSE {_H1}+{_H2}-{_H12} END",
}
CLASSICAL = {
    "ACURCY": _ratio("tp+tn", _N, "0.0"),
    "FALLOUT": f"CASE WHEN tn+fp = 0 THEN {NAN} ELSE 1-tn/(tn+fp) END",
    "FNR": f"CASE WHEN tp+fn = 0 THEN {NAN} ELSE 1-tp/(tp+fn) END",
    "FMEASR": f_measure(),
    "PRCISON": _ratio("tp", "(tp+fp)", "0.0"),
    "SNSVTY": _ratio("tp", "(tp+fn)", NEG),
    "SPCFTY": _ratio("tn", "(tn+fp)", NAN),
    "TP": "tp",
    "TN": "tn",
    "FP": "fp",
    "FN": "fn",
}
INFORMATION = {
    "GCOERR": f"CASE WHEN tp+fn = 0 OR tn+fp = 0 OR tp+fp = 0 OR tn+fn = 0 THEN {INF} ELSE least({_E1}, {_E2}) END",
    "VARINFO": f"CASE WHEN {_ONE_SIDED} THEN {NEG} ELSE {_H1}+{_H2}-2*({_H1}+{_H2}-{_H12}) END",
}
_MU = f"((2*tp+fn+fp)/(2*{_N}))"
_SSW = f"(0.5*(fp+fn)/{_N})"
_SSB = f"(2*(tn*{_MU}*{_MU}+tp*(1-{_MU})*(1-{_MU})+(fp+fn)*(0.5-{_MU})*(0.5-{_MU}))/({_N}-1))"
#: Metrics of the voxels that binary masks give from counts alone.
FROM_COUNTS = {
    "ICCORR": f"CASE WHEN {_N} < 2 THEN {NAN} WHEN {_SSB}+{_SSW} = 0 THEN {NEG} ELSE ({_SSB}-{_SSW})/({_SSB}+{_SSW}) END",
    "PROBDST": _ratio("fp+fn", "(2*tp)", "-1.0"),
}
COUNT_METRICS = {**OVERLAP, **CLASSICAL, **INFORMATION, **FROM_COUNTS}


def volume(side: str, voxel: float = 1.0) -> str:
    return f"(tp+{'fp' if side == 'PREDVOL' else 'fn'})*{voxel}"


#: Continuous metrics over the aggregates of ``operators.evaluate.regression_sums``.
CONTINUOUS = {
    "MAE": "s_abs/n",
    "MSE": "s_sq/n",
    "RMSE": "sqrt(s_sq/n)",
    "NRMSE": f"CASE WHEN hi = lo THEN {NAN} ELSE sqrt(s_sq/n)/(hi-lo) END",
    "R2": f"CASE WHEN n < 2 OR var = 0 THEN {NAN} ELSE 1-s_sq/((n-1)*var) END",
    "PSNR": f"CASE WHEN s_sq = 0 THEN {INF} WHEN hi = 0 THEN {NEG} ELSE 10*log10(hi*hi/(s_sq/n)) END",
}

OVERLAP_METRICS = ["DICE", "ADJRIND", "AUC", "KAPPA", "RNDIND", "JACRD", "ICCORR", "VOLSMTY", "MUTINF", "SURFDICE", "SURFOVLP"]
DISTANCE_METRICS = ["AVGDIST", "GCOERR", "HDRFDST", "MAHLNBS", "PROBDST", "VARINFO"]
CLASSICAL_METRICS = ["ACURCY", "FALLOUT", "FNR", "FMEASR", "PRCISON", "SNSVTY", "SPCFTY", "TP", "TN", "FP", "FN", "PREDVOL", "REFVOL"]
REGRESSION_METRICS = ["MAE", "MSE", "RMSE", "NRMSE", "R2"]
RECONSTRUCTION_METRICS = ["PSNR", "SSIM"]
SEGMENTATION_METRICS = OVERLAP_METRICS + DISTANCE_METRICS + CLASSICAL_METRICS

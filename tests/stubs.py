"""As much of an HDF5 file as the describers and decoders touch, kept as pickles on disk."""

from __future__ import annotations

import pickle

import numpy as np


class Data(np.ndarray):
    """A dataset with attributes."""

    def __new__(cls, values, attrs=None):
        out = np.asarray(values).view(cls)
        out.attrs = attrs or {}
        return out

    def __array_finalize__(self, other):
        self.attrs = getattr(other, "attrs", {})


class Group:
    """A group of datasets and groups, found by path."""

    def __init__(self, items=None, attrs=None):
        self.items_, self.attrs = {}, attrs or {}
        for path, item in (items or {}).items():
            head, _, rest = path.partition("/")
            if not rest:
                self.items_[head] = item
                continue
            self.items_.setdefault(head, Group())
            inner = self.items_[head]
            Group.__init__(inner, {**inner.items_, rest: item}, inner.attrs)

    def keys(self):
        return self.items_.keys()

    def __getitem__(self, path):
        head, _, rest = path.partition("/")
        item = self.items_[head]
        return item[rest] if rest else item

    def __contains__(self, path):
        try:
            self[path]
        except (KeyError, IndexError, TypeError):
            return False
        return True

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return None


def save(path, group: Group) -> None:
    def plain(item):
        return ("g", {k: plain(v) for k, v in item.items_.items()}, item.attrs) if isinstance(item, Group) else ("d", np.asarray(item), item.attrs)

    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(pickle.dumps(plain(group)))


def opener(path: str) -> Group:
    """Opens a stub, and notes beside it that it was opened."""

    def built(t):
        return Group({k: built(v) for k, v in t[1].items()}, t[2]) if t[0] == "g" else Data(t[1], t[2])

    with open(path + ".opened", "a") as f:
        f.write("x")
    with open(path, "rb") as f:
        return built(pickle.loads(f.read()))


def asn(begin=1.7e9, nt=256, late=5, skew=2e-6):
    """Acquired at 500 Hz, written at 100 Hz, every second channel."""
    return Group({
        "data": Data(np.arange(nt * 4, dtype=np.float32).reshape(nt, 4)), "acqSpec/YvsXDelay": Data(1), "header/sensitivities": Data([1e8, 1e8, 2e8, 1e8]), "header/dataScale": Data(1.0), "header/dt": Data(0.002), "header/dx": Data(2.0), "header/channels": Data([0, 2, 4, 6]),
        "header/gaugeLength": Data(10.0), "header/time": Data(begin), "header/name": Data(np.bytes_(b"cable")), "timing/sampleSkew": Data(skew), "header/dimensionRanges/dimension0/unitScale": Data(0.002 * late),
    })


def optasense(begin=1_700_000_000_000_000, nt=256, hole=None):
    us = begin + np.arange(nt) * 10_000
    if hole:
        us[hole:] += 5_000_000
    custom = {"Num Output Channels": 4, "Fibre Refractive Index": 1.468, "Laser Wavelength (nm)": 1550.0, "FPGA Drawing Number": 7804701, "FPGA Version": b"1.9"}
    f = Group({"Acquisition/Raw[0]/RawData": Data(np.arange(4 * nt).reshape(4, nt)), "Acquisition/Raw[0]/RawDataTime": Data(us), "Acquisition/Custom": Group({}, custom)})
    f["Acquisition"].attrs = {"SpatialSamplingInterval": 1.0, "GaugeLength": 10.0, "AcquisitionId": "a"}
    f["Acquisition/Raw[0]"].attrs = {"OutputDataRate": 100.0}
    return f


def apsensing(begin=1_700_000_000_000_000, timed=True):
    x = np.arange(256 * 4, dtype=float).reshape(256, 4)
    return Group({"DAS": Data(x if timed else x.T), "Timestamps/DataTimestamps": Data(begin + np.arange(256)[:, None] * 4000), "ProcessingServer/DataRate": Data([250.0]), "ProcessingServer/SpatialSampling": Data([2.0]), "ProcessingServer/GaugeLength": Data([10.0]), "ProcessingServer/RadiansToNanoStrain": Data([100.0]), "Distances/MeterPositions": Data([0.0, 2.0], {"Start": [5]})})


def processed(origin=None, begin="2023-11-14T22:13:20+00:00", end="2023-11-14T22:13:20.030000+00:00", timed=True):
    x = np.arange(8.0).reshape(4, 2)
    attrs = {"nt": 4, "dt": 0.01, "fs": 100.0, "nCh": 2, "startTime": begin, "endTime": end, "dCh": 2.0, "GaugeLength": 10.0}
    return Group({"Data": Data(x if timed else x.T, attrs), "Acquisition_origin": Data(np.float32(0), origin or {})})


def event():
    attrs = {"event_id": "e1", "dt_s": 0.01, "dx_m": 2.0, "begin_time": "2023-11-14T22:13:20+00:00", "end_time": "2023-11-14T22:13:20.030000+00:00", "event_time_index": 2, "unit": "microstrain/s", "magnitude": 1.5}
    return Group({"data": Data(np.arange(8, dtype=np.float32).reshape(2, 4), attrs)})

"""As much of an HDF5 library as the reader needs, over npz files; writes down which rows were read."""

import io
import os

import numpy as np


class Array:
    def __init__(self, name, values, log):
        self.name, self.values, self.log = name, values, log

    def __len__(self):
        return len(self.values)

    def __getitem__(self, at):
        got = self.values[at]
        if self.log:
            with open(self.log, "a") as f:
                f.write(f"{self.name} {len(got)}\n")
        return got


class File:
    def __init__(self, raw, mode):
        assert mode == "r"
        with np.load(io.BytesIO(raw.read())) as z:
            self.arrays = {k: z[k] for k in z.files}
        self.log = os.environ.get("STANDIN_LOG") or (str(self.arrays["log"]) if "log" in self.arrays else None)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass

    def __contains__(self, name):
        return name in self.arrays

    def __getitem__(self, name):
        return Array(name, self.arrays[name], self.log)

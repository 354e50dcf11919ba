"""L13: one writer at a time on a folder, by a lease in the folder itself.

The lease is a file that only one process can create. Its holder renews it while it
works, so the lease of a process that died runs out and another takes it over. It works
on any file system that Spark reaches, not only on a local one.
"""

from __future__ import annotations

import math
import os
import socket
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from irloom.sources.snapshot import local_path

NAME, LEASE_SECONDS, POLL_SECONDS = "writer.lease", 30.0, 0.1


class LockTimeoutError(Exception):
    """Another writer held the lease for all of the time given."""


def _holder(fs, lease) -> str:
    try:
        stream = fs.open(lease)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8", "replace").strip() or "an unknown process"
        finally:
            stream.close()
    except Exception:  # noqa: BLE001  gone or unreadable: only a message is made of it
        return "an unknown process"


def _take(fs, lease, text: str) -> bool:
    if here := local_path(fs, lease):  # Hadoop's local file system looks first and creates then; this is one step
        os.makedirs(os.path.dirname(here), exist_ok=True)
        try:
            f = os.open(here, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644)
        except FileExistsError:
            return False
        os.write(f, text.encode())
        os.close(f)
        return True
    try:
        out = fs.create(lease, False)  # fails if it is there
    except Exception:  # noqa: BLE001  each file system has an exception of its own
        if fs.exists(lease):
            return False
        raise
    out.write(text.encode())
    out.close()
    return True


def _ran_out(fs, lease, seconds: float) -> bool:
    try:
        return time.time() - fs.getFileStatus(lease).getModificationTime() / 1000 > seconds
    except Exception:  # noqa: BLE001  it went meanwhile
        return False


@contextmanager
def build_lock(spark: SparkSession, folder: str, timeout: float, lease_seconds: float = LEASE_SECONDS) -> Iterator[None]:
    """Hold the folder's lease for the block; LockTimeoutError names who has it after `timeout` seconds."""
    if not (isinstance(timeout, int | float) and 0 < timeout < math.inf):
        raise ValueError(f"the time to wait must be a finite number above 0, not {timeout!r}")
    lease = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{NAME}")
    fs = lease.getFileSystem(spark._jsc.hadoopConfiguration())
    text = f"process {os.getpid()} on {socket.gethostname()}, {uuid.uuid4().hex}"
    until = time.monotonic() + timeout
    while not _take(fs, lease, text):
        if _ran_out(fs, lease, lease_seconds):
            # Only one of those who find it run out can move it away; a new one that it caught instead goes back.
            old, gone = _holder(fs, lease), spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{NAME}.{uuid.uuid4().hex}")
            if _ran_out(fs, lease, lease_seconds) and fs.rename(lease, gone):
                if _holder(fs, gone) != old:
                    fs.rename(gone, lease)
                else:
                    fs.delete(gone, False)
            continue
        if time.monotonic() >= until:
            raise LockTimeoutError(f"waited {timeout:g} s for the lease on {folder}, held by {_holder(fs, lease)}")
        time.sleep(POLL_SECONDS)
    done = threading.Event()

    def renew() -> None:
        while not done.wait(lease_seconds / 4):
            fs.setTimes(lease, int(time.time() * 1000), -1)

    keeper = threading.Thread(target=renew, daemon=True)
    keeper.start()
    try:
        yield
    finally:
        done.set()
        keeper.join()
        if _holder(fs, lease) == text:
            fs.delete(lease, False)

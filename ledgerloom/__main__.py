"""``python -m ledgerloom``: check-rpc, version, index, follow, the two refreshes, rollback, and the three rebuilds."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="ledgerloom")
    p.add_argument("command", choices=["check-rpc", "version", "index", "follow", "refresh-mempool", "refresh-deployments", "rollback", "rebuild-accounting", "rebuild-supply-rollup", "rebuild-address-distribution"])
    p.add_argument("--store")
    p.add_argument("--blocks", help="folder of block documents")
    p.add_argument("--resolver", help="Parquet table pubkey_hex, address")
    p.add_argument("--network", default="main")
    p.add_argument("--height", type=int)
    p.add_argument("--url")
    p.add_argument("--user", default="")
    p.add_argument("--password", default="")
    a = p.parse_args(argv)
    if a.command == "check-rpc":
        from .sources.node import Rpc, check_startup

        status = Rpc(a.url, a.user, a.password).status()
        check_startup(status, a.network)
        print(json.dumps(status["getblockchaininfo"]))
        return 0
    from .functions.subsidy import schedule_for
    from .sources.store import Store
    from .streaming import apply

    spark = SparkSession.builder.appName("ledgerloom").getOrCreate()
    store, schedule = Store(spark, a.store), schedule_for(a.network)
    if a.command == "version":
        print(json.dumps(store.current().manifest))
    elif a.command in ("follow", "refresh-mempool", "refresh-deployments"):
        from .streaming import follow

        options = {"url": a.url, "user": a.user, "password": a.password}
        if a.command == "follow":
            follow.follow(store, options, schedule, a.network)
        else:
            (follow.refresh_mempool if a.command == "refresh-mempool" else follow.refresh_deployments)(store, options)
    elif a.command == "rollback":
        apply.rollback_to(store, a.height, schedule)
    elif a.command == "index":
        from .operators.decode import decode_blocks
        from .sources.node import block_files

        apply.apply_blocks(store, apply.from_decoded(decode_blocks(block_files(spark, a.blocks), spark.read.parquet(a.resolver))), schedule, a.network)
    else:  # all derived tables follow from the bodies, whichever is asked for
        with store.writing():
            version = store.current()
            tables = apply.derive(store, {n: version.table(n) for n in apply.BODIES}, schedule, apply.stored_rollup(version))
            names = {"rebuild-accounting": "accounting", "rebuild-supply-rollup": "rollup", "rebuild-address-distribution": "distribution"}
            tip = version.manifest["indexed_block_hash"]
            store.publish({names[a.command]: tables[names[a.command]]}, rollup_anchor=tip, distribution_anchor=tip)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""python -m siltstone [--stdin | --serve] [--config FILE]: run a script from standard input, or serve HTTP."""

from __future__ import annotations

import argparse
import sys
import threading
import time

from siltstone.config import load
from siltstone.functions.macros import register
from siltstone.plans.catalog import Lakehouse
from siltstone.plans.query import run_script, to_json
from siltstone.session import build_session


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="siltstone", description=__doc__)
    parser.add_argument("--stdin", action="store_true")
    parser.add_argument("--serve", action="store_true")
    parser.add_argument("--config")
    args = parser.parse_args(arguments)
    settings, spark = load(args.config), build_session()
    register(spark)
    if args.stdin:
        for result in run_script(spark, sys.stdin.read()):
            if result.columns:
                print(to_json(result))
        return 0
    if args.serve and not settings.enabled:
        print("serving is disabled by the settings", file=sys.stderr)
        return 1
    if args.serve:
        from siltstone.gateway import serve

        lake = Lakehouse(spark, settings.root, settings.grace_s, settings.row_group_rows)
        if not settings.no_merges:

            def merge_loop() -> None:
                while True:
                    time.sleep(settings.merge_timeout_s)
                    try:
                        lake.maintain(settings.merge_timeout_s)
                    except Exception as e:  # noqa: BLE001
                        print(f"maintenance: {e}", file=sys.stderr)

            threading.Thread(target=merge_loop, daemon=True).start()
        serve(lake, settings.host, settings.port, settings.save_timeout_s, settings.secret, settings.allow_save_to_hd).serve_forever()
    parser.print_help()
    return 1


if __name__ == "__main__":
    sys.exit(main())

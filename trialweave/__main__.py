"""python -m trialweave -cf config.yaml"""

from __future__ import annotations

import argparse
import logging


def main() -> None:
    parser = argparse.ArgumentParser(prog="trialweave")
    parser.add_argument("-cf", "--config_file", required=True)
    args = parser.parse_args()
    from pyspark.sql import SparkSession

    from .plans.config import load
    from .plans.engine import run_campaign

    config = load(args.config_file)
    logging.basicConfig(level=str(config.get("logging", "INFO")).upper())
    spark = SparkSession.builder.appName("trialweave").getOrCreate()
    try:
        run_campaign(spark, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

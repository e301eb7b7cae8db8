"""Operators of a training-data pipeline: near and exact duplicates, licence and secret scans, HTML extraction, chat formatting, quality, mixing, decontamination, URL filters."""

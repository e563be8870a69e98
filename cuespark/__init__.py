"""Timed captions from streams of video-frame observations, as Spark DataFrames."""

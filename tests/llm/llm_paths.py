"""Folder of the small test tables."""

SF = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"

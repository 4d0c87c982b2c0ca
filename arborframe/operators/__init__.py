"""Operators: binning, histograms, split search, sampling, ranking, trees and growth."""

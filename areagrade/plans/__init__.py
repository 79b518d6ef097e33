"""The statistics, exposure and scorecard jobs as compositions of operators."""

"""Jobs composed of operators: learning, forecasting, evaluation, sweeps."""

"""Jobs over readings, headlines and candidates: DataFrame in, DataFrame out, no actions."""

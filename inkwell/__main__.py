import sys

from inkwell.plans.cli import main

sys.exit(main())

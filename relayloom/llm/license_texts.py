"""Whole licence texts: the short ones as they are, of the long ones the number of times each word occurs.

There is none of AGPL-3.0 and of the CC BY family; see `licenses.Scanner.whole`."""

from __future__ import annotations

_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "

TEXTS: dict[str, str] = {
    "BSD-2-Clause": "BSD 2-Clause License. " + _BSD_2 + _DISCLAIMER,
    "BSD-3-Clause": "BSD 3-Clause License. " + _BSD_2 + _BSD_3 + _DISCLAIMER,
    "ISC": 'ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT": 'MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to http://unlicense.org',
}

#: Words and their counts, most frequent first.
COUNTS: dict[str, str] = {
    "Apache-2.0": "the:100 or:69 of:67 and:46 to:40 license:35 work:34 any:30 you:26 for:24 in:24 by:23 that:22 a:22 works:19 such:18 derivative:18 as:17 this:17 shall:15 conditions:13 copyright:13 your:13 form:13 source:12 not:12 with:11 on:11 use:10 mean:10 licensor:10 entity:10 is:10 contributor:10 terms:9 under:9 including:9 notice:9 may:9 contribution:8 within:8 notices:8 file:8 other:7 an:7 patent:7 apache:6 owner:6 are:6 otherwise:6 modifications:6 object:6 if:6 distribution:5 legal:5 but:5 from:5 provided:5 behalf:5 distribute:5 without:5 additional:5 be:5 liability:5 damages:5 reproduction:4 control:4 purposes:4 whether:4 limited:4 thereof:4 submitted:4 writing:4 each:4 no:4 only:4 must:4 attribution:4 part:4 text:4 own:4 unless:4 required:4 warranty:4 version:3 2.0:3 licenses:3 all:3 direct:3 individual:3 permissions:3 code:3 documentation:3 files:3 authorship:3 include:3 name:3 communication:3 its:3 purpose:3 excluding:3 grant:3 non:3 charge:3 except:3 those:3 s:3 following:3 copy:3 do:3 distributed:3 contributions:3 applicable:3 law:3 agreed:3 warranties:3 accepting:3 http:2 www:2 org:2 1:2 9:2 authorized:2 definition:2 means:2 indirect:2 cause:2 contract:2 ownership:2 granted:2 software:2 generated:2 made:2 included:2 appendix:2 which:2 whole:2 original:2 intentionally:2 inclusion:2 electronic:2 systems:2 has:2 been:2 incorporated:2 subject:2 hereby:2 grants:2 perpetual:2 worldwide:2 exclusive:2 royalty:2 free:2 irrevocable:2 reproduce:2 publicly:2 display:2 stated:2 have:2 offer:2 sell:2 claims:2 their:2 litigation:2 against:2 infringement:2 then:2 pertain:2 at:2 third:2 party:2 modify:2 add:2 trademarks:2 names:2 provides:2 basis:2 kind:2 either:2 express:2 implied:2 limitation:2 redistributing:2 obligations:2 apply:2 enclosed:2 brackets:2 january:1 2004:1 definitions:1 defined:1 sections:1 through:1 document:1 granting:1 union:1 acting:1 entities:1 controlled:1 common:1 i:1 power:1 direction:1 management:1 ii:1 fifty:1 percent:1 50:1 more:1 outstanding:1 shares:1 iii:1 beneficial:1 exercising:1 preferred:1 making:1 configuration:1 resulting:1 mechanical:1 transformation:1 translation:1 compiled:1 conversions:1 media:1 types:1 available:1 indicated:1 attached:1 example:1 below:1 based:1 derived:1 editorial:1 revisions:1 annotations:1 elaborations:1 represent:1 remain:1 separable:1 merely:1 link:1 bind:1 interfaces:1 additions:1 submit:1 verbal:1 written:1 sent:1 representatives:1 mailing:1 lists:1 issue:1 tracking:1 managed:1 discussing:1 improving:1 conspicuously:1 marked:1 designated:1 whom:1 received:1 subsequently:1 2:1 prepare:1 perform:1 sublicense:1 3:1 section:1 make:1 import:1 transfer:1 where:1 applies:1 licensable:1 necessarily:1 infringed:1 alone:1 combination:1 was:1 institute:1 cross:1 claim:1 counterclaim:1 lawsuit:1 alleging:1 constitutes:1 contributory:1 terminate:1 date:1 filed:1 4:1 redistribution:1 copies:1 medium:1 meet:1 give:1 recipients:1 b:1 modified:1 carry:1 prominent:1 stating:1 changed:1 c:1 retain:1 trademark:1 d:1 includes:1 readable:1 contained:1 least:1 one:1 places:1 along:1 wherever:1 normally:1 appear:1 contents:1 informational:1 alongside:1 addendum:1 cannot:1 construed:1 modifying:1 statement:1 provide:1 different:1 complies:1 5:1 submission:1 explicitly:1 state:1 notwithstanding:1 above:1 nothing:1 herein:1 supersede:1 separate:1 agreement:1 executed:1 regarding:1 6:1 does:1 permission:1 trade:1 service:1 marks:1 product:1 reasonable:1 customary:1 describing:1 origin:1 reproducing:1 content:1 7:1 disclaimer:1 title:1 merchantability:1 fitness:1 particular:1 solely:1 responsible:1 determining:1 appropriateness:1 using:1 assume:1 risks:1 associated:1 exercise:1 8:1 event:1 theory:1 tort:1 negligence:1 deliberate:1 grossly:1 negligent:1 acts:1 liable:1 special:1 incidental:1 consequential:1 character:1 arising:1 result:1 out:1 inability:1 loss:1 goodwill:1 stoppage:1 computer:1 failure:1 malfunction:1 commercial:1 losses:1 even:1 advised:1 possibility:1 while:1 choose:1 fee:1 acceptance:1 support:1 indemnity:1 rights:1 consistent:1 however:1 act:1 sole:1 responsibility:1 agree:1 indemnify:1 defend:1 hold:1 harmless:1 incurred:1 asserted:1 reason:1 end:1 how:1 attach:1 boilerplate:1 fields:1 replaced:1 identifying:1 information:1 don:1 t:1 should:1 appropriate:1 comment:1 syntax:1 format:1 we:1 also:1 recommend:1 class:1 description:1 same:1 printed:1 page:1 easier:1 identification:1 archives:1 yyyy:1 licensed:1 compliance:1 obtain:1 see:1 specific:1 language:1 governing:1 limitations:1",
    "CC0-1.0": "the:66 and:55 of:50 or:45 to:29 work:26 any:24 rights:22 in:21 a:18 for:18 affirmer:17 copyright:11 related:11 s:11 not:10 by:10 as:9 including:9 commons:8 law:8 purpose:8 creative:7 cc:7 0:7 this:7 use:7 without:7 other:7 under:7 applicable:7 waiver:7 is:6 that:6 be:6 license:6 legal:5 document:5 an:5 works:5 all:5 purposes:5 limitation:5 extent:5 such:5 future:5 on:4 no:4 provided:4 statement:4 each:4 public:4 claims:4 person:4 with:4 i:4 ii:4 action:4 shall:4 express:4 non:4 information:3 makes:3 warranties:3 disclaims:3 owner:3 those:3 whatsoever:3 commercial:3 may:3 part:3 iii:3 iv:3 thereof:3 treaty:3 hereby:3 causes:3 maximum:3 judged:3 does:2 distribution:2 hereunder:2 throughout:2 world:2 exclusive:2 below:2 upon:2 original:2 database:2 owners:2 permanently:2 cultural:2 scientific:2 infringement:2 reuse:2 these:2 free:2 further:2 he:2 she:2 apply:2 distribute:2 his:2 her:2 but:2 are:2 protecting:2 subject:2 limitations:2 4:2 directive:2 national:2 greatest:2 permitted:2 fully:2 associated:2 whether:2 territories:2 worldwide:2 duration:2 time:2 extensions:2 current:2 medium:2 number:2 copies:2 advertising:2 promotional:2 should:2 reason:2 legally:2 invalid:2 ineffective:2 affected:2 exercise:2 case:2 respect:2 otherwise:2 absence:2 responsibility:2 code:1 1.0:1 universal:1 corporation:1 firm:1 provide:1 services:1 create:1 attorney:1 client:1 relationship:1 provides:1 basis:1 regarding:1 liability:1 damages:1 resulting:1 from:1 laws:1 most:1 jurisdictions:1 automatically:1 confer:1 defined:1 creator:1 subsequent:1 authorship:1 certain:1 wish:1 relinquish:1 contributing:1 can:1 reliably:1 fear:1 later:1 build:1 modify:1 incorporate:1 redistribute:1 freely:1 possible:1 form:1 contribute:1 promote:1 ideal:1 culture:1 production:1 gain:1 reputation:1 greater:1 their:1 through:1 efforts:1 others:1 motivations:1 expectation:1 additional:1 consideration:1 compensation:1 associating:1 voluntarily:1 elects:1 publicly:1 its:1 terms:1 knowledge:1 meaning:1 intended:1 effect:1 1:1 made:1 available:1 protected:1 neighboring:1 include:1 limited:1 following:1 right:1 reproduce:1 adapt:1 perform:1 display:1 communicate:1 translate:1 moral:1 retained:1 author:1 performer:1 publicity:1 privacy:1 pertaining:1 image:1 likeness:1 depicted:1 against:1 unfair:1 competition:1 regards:1 paragraph:1 v:1 extraction:1 dissemination:1 data:1 vi:1 arising:1 96:1 9:1 ec:1 european:1 parliament:1 council:1 11:1 march:1 1996:1 protection:1 databases:1 implementation:1 amended:1 successor:1 version:1 vii:1 similar:1 equivalent:1 corresponding:1 based:1 implementations:1 2:1 contravention:1 overtly:1 irrevocably:1 unconditionally:1 waives:1 abandons:1 surrenders:1 now:1 known:1 unknown:1 existing:1 well:1 benefit:1 member:1 at:1 large:1 detriment:1 heirs:1 successors:1 intending:1 revocation:1 rescission:1 cancellation:1 termination:1 equitable:1 disrupt:1 quiet:1 enjoyment:1 contemplated:1 3:1 fallback:1 then:1 preserved:1 taking:1 into:1 account:1 addition:1 so:1 grants:1 royalty:1 transferable:1 sublicensable:1 irrevocable:1 unconditional:1 deemed:1 effective:1 date:1 was:1 applied:1 partial:1 invalidity:1 ineffectiveness:1 invalidate:1 remainder:1 affirms:1 will:1 remaining:1 assert:1 either:1 contrary:1 disclaimers:1 trademark:1 patent:1 held:1 waived:1 abandoned:1 surrendered:1 licensed:1 b:1 offers:1 representations:1 kind:1 concerning:1 implied:1 statutory:1 title:1 merchantability:1 fitness:1 particular:1 latent:1 defects:1 accuracy:1 present:1 errors:1 discoverable:1 permissible:1 c:1 clearing:1 persons:1 obtaining:1 necessary:1 consents:1 permissions:1 required:1 d:1 understands:1 acknowledges:1 party:1 has:1 duty:1 obligation:1",
    "GPL-2.0": "the:194 to:108 of:104 or:77 you:76 and:72 program:71 a:57 is:53 this:49 license:46 it:39 for:39 any:38 software:35 that:35 not:34 if:32 in:29 free:28 by:28 on:26 work:24 as:21 your:20 distribute:19 under:19 copy:18 other:18 terms:18 with:17 may:17 public:16 source:16 code:16 be:16 distribution:16 general:15 copyright:14 all:14 version:13 are:13 warranty:13 conditions:13 such:12 based:12 have:11 these:11 rights:11 foundation:10 which:10 from:10 make:9 we:9 use:9 modify:9 must:9 an:9 section:9 gnu:8 2:8 c:8 copies:8 can:8 do:8 show:8 so:8 each:8 no:8 will:8 at:8 but:7 its:7 when:7 1:7 distributed:7 either:7 whole:7 parties:7 executable:7 apply:6 programs:6 new:6 they:6 notice:6 does:6 above:6 redistribute:6 sections:6 change:5 s:5 charge:5 want:5 offer:5 also:5 author:5 what:5 patent:5 only:5 third:5 works:5 who:5 system:5 should:5 everyone:4 permitted:4 licenses:4 most:4 freedom:4 intended:4 receive:4 certain:4 give:4 recipients:4 modified:4 original:4 made:4 licensed:4 copying:4 modification:4 holder:4 law:4 without:4 medium:4 provided:4 thus:4 part:4 interactive:4 including:4 then:4 written:4 object:4 form:4 received:4 even:4 purpose:4 inc:3 verbatim:3 sure:3 applies:3 whose:3 covered:3 our:3 wish:3 get:3 know:3 restrictions:3 whether:3 fee:3 them:3 permission:3 there:3 else:3 patents:3 proprietary:3 contains:3 means:3 derivative:3 portion:3 modifications:3 into:3 limitation:3 than:3 running:3 publish:3 appropriate:3 notices:3 along:3 option:3 cause:3 files:3 b:3 normally:3 commands:3 way:3 print:3 announcement:3 how:3 required:3 those:3 following:3 accompany:3 complete:3 corresponding:3 used:3 party:3 more:3 however:3 otherwise:3 time:3 consequence:3 limited:3 permit:3 through:3 particular:3 countries:3 number:3 later:3 published:3 write:3 implied:3 damages:3 name:3 details:3 gnomovision:3 w:3 1991:2 1989:2 51:2 franklin:2 street:2 fifth:2 floor:2 boston:2 ma:2 02110:2 1301:2 usa:2 allowed:2 designed:2 share:2 users:2 authors:2 lesser:2 instead:2 too:2 protect:2 need:2 ask:2 example:2 their:2 two:2 protection:2 problems:2 making:2 clear:2 saying:2 another:2 licensee:2 scope:2 act:2 restricted:2 output:2 independent:2 been:2 disclaimer:2 derived:2 provide:2 exception:2 itself:2 separate:2 same:2 entire:2 intent:2 contest:2 entirely:2 exercise:2 right:2 control:2 one:2 machine:2 readable:2 customarily:2 interchange:2 least:2 cost:2 information:2 plus:2 special:2 unless:2 offering:2 access:2 place:2 sublicense:2 except:2 automatically:2 full:2 compliance:2 accept:2 modifying:2 distributing:2 impose:2 court:2 cannot:2 satisfy:2 obligations:2 would:2 could:2 claims:2 has:2 copyrighted:2 add:2 versions:2 parts:2 applicable:2 writing:2 merchantability:2 fitness:2 necessary:2 data:2 attach:2 file:2 line:2 year:2 useful:2 type:2 ty:2 coon:2 library:2 june:1 document:1 changing:1 preamble:1 take:1 away:1 contrast:1 guarantee:1 commit:1 using:1 some:1 speak:1 referring:1 price:1 service:1 pieces:1 things:1 forbid:1 anyone:1 deny:1 surrender:1 translate:1 responsibilities:1 gratis:1 steps:1 gives:1 legal:1 ours:1 understands:1 someone:1 passed:1 introduced:1 others:1 reflect:1 reputations:1 finally:1 threatened:1 constantly:1 avoid:1 danger:1 redistributors:1 individually:1 obtain:1 effect:1 prevent:1 precise:1 follow:1 0:1 placed:1 below:1 refers:1 say:1 containing:1 translated:1 language:1 hereinafter:1 translation:1 included:1 term:1 addressed:1 activities:1 outside:1 contents:1 constitute:1 having:1 true:1 depends:1 conspicuously:1 appropriately:1 keep:1 intact:1 refer:1 absence:1 physical:1 transferring:1 exchange:1 forming:1 meet:1 carry:1 prominent:1 stating:1 changed:1 date:1 thereof:1 reads:1 interactively:1 run:1 started:1 ordinary:1 display:1 telling:1 user:1 view:1 requirements:1 identifiable:1 reasonably:1 considered:1 themselves:1 permissions:1 licensees:1 extend:1 every:1 regardless:1 wrote:1 claim:1 rather:1 collective:1 addition:1 mere:1 aggregation:1 volume:1 storage:1 bring:1 3:1 valid:1 three:1 years:1 physically:1 performing:1 alternative:1 noncommercial:1 accord:1 subsection:1 preferred:1 modules:1 associated:1 interface:1 definition:1 scripts:1 compilation:1 installation:1 include:1 anything:1 binary:1 major:1 components:1 compiler:1 kernel:1 operating:1 runs:1 component:1 accompanies:1 designated:1 equivalent:1 counts:1 though:1 compelled:1 4:1 expressly:1 attempt:1 void:1 terminate:1 terminated:1 long:1 remain:1 5:1 since:1 signed:1 nothing:1 grants:1 actions:1 prohibited:1 therefore:1 indicate:1 acceptance:1 6:1 recipient:1 receives:1 licensor:1 subject:1 further:1 granted:1 herein:1 responsible:1 enforcing:1 7:1 judgment:1 allegation:1 infringement:1 reason:1 issues:1 imposed:1 order:1 agreement:1 contradict:1 excuse:1 simultaneously:1 pertinent:1 royalty:1 redistribution:1 directly:1 indirectly:1 both:1 refrain:1 held:1 invalid:1 unenforceable:1 circumstance:1 balance:1 circumstances:1 induce:1 infringe:1 property:1 validity:1 sole:1 protecting:1 integrity:1 implemented:1 practices:1 many:1 people:1 generous:1 contributions:1 wide:1 range:1 reliance:1 consistent:1 application:1 up:1 donor:1 decide:1 he:1 she:1 willing:1 choice:1 thoroughly:1 believed:1 rest:1 8:1 interfaces:1 places:1 explicit:1 geographical:1 excluding:1 among:1 excluded:1 case:1 incorporates:1 body:1 9:1 revised:1 similar:1 spirit:1 present:1 differ:1 detail:1 address:1 concerns:1 given:1 distinguishing:1 specifies:1 specify:1 choose:1 ever:1 10:1 incorporate:1 different:1 sometimes:1 exceptions:1 decision:1 guided:1 goals:1 preserving:1 status:1 derivatives:1 promoting:1 sharing:1 reuse:1 generally:1 11:1 because:1 extent:1 stated:1 holders:1 kind:1 expressed:1 warranties:1 risk:1 quality:1 performance:1 prove:1 defective:1 assume:1 servicing:1 repair:1 correction:1 12:1 event:1 agreed:1 liable:1 incidental:1 consequential:1 arising:1 out:1 inability:1 loss:1 being:1 rendered:1 inaccurate:1 losses:1 sustained:1 failure:1 operate:1 advised:1 possibility:1 end:1 develop:1 greatest:1 possible:1 best:1 achieve:1 safest:1 start:1 effectively:1 convey:1 exclusion:1 pointer:1 where:1 found:1 brief:1 idea:1 hope:1 see:1 contact:1 electronic:1 paper:1 mail:1 short:1 like:1 starts:1 mode:1 69:1 comes:1 absolutely:1 welcome:1 hypothetical:1 course:1 called:1 something:1 mouse:1 clicks:1 menu:1 items:1 whatever:1 suits:1 employer:1 programmer:1 school:1 sign:1 here:1 sample:1 alter:1 names:1 yoyodyne:1 hereby:1 disclaims:1 interest:1 makes:1 passes:1 compilers:1 james:1 hacker:1 signature:1 april:1 president:1 vice:1 incorporating:1 subroutine:1 consider:1 linking:1 applications:1",
    "GPL-3.0": "the:345 of:221 to:192 a:184 or:151 you:128 license:102 and:98 work:97 that:91 this:86 for:86 in:81 is:70 it:52 program:52 not:51 any:50 if:49 with:45 under:44 by:43 source:42 covered:41 as:38 your:34 code:34 terms:32 on:31 may:31 copyright:30 other:30 from:29 be:29 are:28 software:27 an:26 convey:26 public:25 version:25 copy:25 use:24 general:23 corresponding:23 patent:23 gnu:22 all:21 such:21 which:21 object:21 product:21 free:20 rights:19 means:18 no:17 but:16 do:16 warranty:15 user:15 conveying:15 section:15 copies:14 versions:14 make:14 apply:14 have:14 must:14 those:14 conditions:14 additional:14 can:13 modified:13 provided:13 does:13 material:13 works:12 modify:12 used:12 s:12 party:12 so:11 legal:11 notices:11 form:11 its:10 these:10 permission:10 each:10 part:10 law:10 particular:10 permissions:10 holder:10 contributor:10 licenses:9 users:9 non:9 either:9 propagate:9 applicable:9 available:9 third:9 has:9 c:8 freedom:8 charge:8 them:8 receive:8 received:8 offer:8 will:8 run:8 making:8 parties:8 network:8 appropriate:8 notice:8 only:8 including:8 who:8 at:8 further:8 information:8 we:7 also:7 way:7 authors:7 when:7 new:7 recipients:7 gpl:7 some:7 without:7 would:7 interface:7 one:7 b:7 granted:7 more:7 transaction:7 liability:7 3:6 foundation:6 designed:6 programs:6 they:6 show:6 their:6 1:6 2:6 access:6 patents:6 should:6 modification:6 based:6 extent:6 how:6 include:6 control:6 however:6 parts:6 otherwise:6 medium:6 give:6 physical:6 reasonable:6 been:6 permitted:5 distribute:5 most:5 change:5 need:5 example:5 whether:5 same:5 where:5 purpose:5 distribution:5 system:5 major:5 component:5 require:5 stated:5 provide:5 circumvention:5 shall:5 along:5 requirement:5 into:5 regardless:5 server:5 place:5 requirements:5 unless:5 recipient:5 grant:5 violation:5 later:5 https:4 org:4 price:4 get:4 others:4 therefore:4 certain:4 fee:4 install:4 special:4 copying:4 requiring:4 than:4 anything:4 except:4 propagation:4 includes:4 through:4 interactive:4 files:4 automatically:4 term:4 10:4 obligations:4 4:4 stating:4 permissive:4 accord:4 7:4 entire:4 anyone:4 d:4 what:4 written:4 valid:4 different:4 using:4 peer:4 consumer:4 installation:4 required:4 add:4 author:4 licensors:4 then:4 permanently:4 time:4 acceptance:4 exercise:4 claims:4 connection:4 implied:4 2007:3 verbatim:3 document:3 allowed:3 sure:3 remains:3 want:3 protect:3 developers:3 there:3 problems:3 products:3 provision:3 needed:3 could:3 proprietary:3 cannot:3 follow:3 refers:3 licensed:3 resulting:3 called:3 unmodified:3 infringement:3 activities:3 interaction:3 commands:3 prominent:3 modifications:3 standard:3 interfaces:3 libraries:3 executable:3 whole:3 included:3 essential:3 specific:3 specifically:3 data:3 output:3 running:3 given:3 equivalent:3 long:3 solely:3 technological:3 11:3 measures:3 keep:3 intact:3 added:3 support:3 possession:3 separately:3 compilation:3 aggregate:3 permit:3 6:3 sections:3 accompanied:3 satisfy:3 library:3 purposes:3 uses:3 right:3 conveyed:3 installed:3 governed:3 option:3 limiting:3 15:3 16:3 impose:3 restriction:3 above:3 reinstated:3 prior:3 consequence:3 grants:3 receives:3 predecessor:3 royalty:3 infringed:3 manner:3 following:3 agreement:3 country:3 arrangement:3 affero:3 published:3 disclaimer:3 damages:3 redistribute:3 name:3 see:3 details:3 www:3 everyone:2 kinds:2 share:2 our:2 applies:2 released:2 too:2 wish:2 know:2 prevent:2 surrender:2 responsibilities:2 respect:2 gratis:2 giving:2 protection:2 both:2 marked:2 previous:2 protecting:2 occurs:2 individuals:2 prohibit:2 practice:2 substantially:2 domains:2 extend:2 future:2 finally:2 effectively:2 like:2 laws:2 licensees:2 organizations:2 earlier:2 directly:2 liable:2 computer:2 modifying:2 kind:2 displays:2 warranties:2 list:2 case:2 specified:2 language:2 implementation:2 produce:2 performing:2 definition:2 subprograms:2 communication:2 explicitly:2 having:2 exclusively:2 facilities:2 thus:2 similar:2 prohibiting:2 forbid:2 limit:2 operation:2 enforcing:2 against:2 publish:2 5:2 carry:2 relevant:2 modifies:2 comes:2 display:2 combined:2 individual:2 cause:2 ways:2 embodied:2 fixed:2 durable:2 customarily:2 interchange:2 least:2 three:2 cost:2 subsection:2 offering:2 find:2 ensure:2 e:2 transmission:2 being:2 portion:2 personal:2 normally:2 cases:2 coverage:2 mode:2 made:2 continue:2 service:2 publicly:2 supplement:2 exceptions:2 remove:2 notwithstanding:2 holders:2 original:2 names:2 conveys:2 contractual:2 assumptions:2 restrictions:2 within:2 contains:2 relicensing:2 statement:2 termination:2 terminate:2 paragraph:2 days:2 after:2 first:2 accept:2 order:2 nothing:2 infringe:2 downstream:2 entity:2 organization:2 interest:2 claim:2 selling:2 sale:2 authorizes:2 acquired:2 consistent:2 express:2 commitment:2 enforce:2 knowingly:2 relying:2 arrange:2 single:2 discriminatory:2 imposed:2 13:2 revised:2 number:2 specifies:2 numbered:2 choose:2 proxy:2 writing:2 limited:2 merchantability:2 fitness:2 necessary:2 limitation:2 even:2 local:2 attach:2 file:2 line:2 year:2 useful:2 type:2 w:2 29:1 june:1 inc:1 fsf:1 changing:1 preamble:1 copyleft:1 practical:1 take:1 away:1 contrast:1 intended:1 guarantee:1 speak:1 referring:1 pieces:1 things:1 denying:1 asking:1 pass:1 freedoms:1 two:1 steps:1 assert:1 clearly:1 explains:1 sake:1 requires:1 changed:1 attributed:1 erroneously:1 devices:1 deny:1 inside:1 although:1 manufacturer:1 fundamentally:1 incompatible:1 aim:1 systematic:1 pattern:1 abuse:1 area:1 precisely:1 unacceptable:1 arise:1 stand:1 ready:1 every:1 threatened:1 constantly:1 states:1 allow:1 restrict:1 development:1 computers:1 avoid:1 danger:1 applied:1 assures:1 render:1 precise:1 0:1 definitions:1 semiconductor:1 masks:1 copyrightable:1 licensee:1 addressed:1 adapt:1 fashion:1 exact:1 secondarily:1 executing:1 private:1 countries:1 well:1 enables:1 mere:1 transfer:1 convenient:1 prominently:1 visible:1 feature:1 tells:1 view:1 presents:1 options:1 menu:1 item:1 meets:1 criterion:1 preferred:1 official:1 defined:1 recognized:1 standards:1 body:1 programming:1 widely:1 among:1 working:1 normal:1 packaging:1 serves:1 enable:1 implement:1 context:1 kernel:1 window:1 operating:1 runs:1 compiler:1 interpreter:1 generate:1 scripts:1 tools:1 generally:1 associated:1 shared:1 dynamically:1 linked:1 intimate:1 flow:1 between:1 regenerate:1 basic:1 irrevocable:1 met:1 affirms:1 unlimited:1 content:1 constitutes:1 acknowledges:1 fair:1 force:1 sole:1 comply:1 behalf:1 direction:1 copyrighted:1 outside:1 relationship:1 circumstances:1 below:1 sublicensing:1 makes:1 unnecessary:1 anti:1 deemed:1 effective:1 measure:1 fulfilling:1 article:1 wipo:1 treaty:1 adopted:1 20:1 december:1 1996:1 restricting:1 waive:1 power:1 effected:1 exercising:1 disclaim:1 intention:1 conspicuously:1 appropriately:1 absence:1 meet:1 date:1 packaged:1 gives:1 invalidate:1 separate:1 independent:1 nature:1 extensions:1 larger:1 volume:1 storage:1 beyond:1 inclusion:1 forms:1 machine:1 readable:1 years:1 spare:1 customer:1 model:1 possesses:1 physically:1 alternative:1 occasionally:1 noncommercially:1 designated:1 operated:1 supports:1 maintain:1 clear:1 directions:1 next:1 saying:1 hosts:1 remain:1 obligated:1 inform:1 peers:1 offered:1 separable:1 whose:1 excluded:1 tangible:1 property:1 family:1 household:1 sold:1 incorporation:1 dwelling:1 determining:1 doubtful:1 resolved:1 favor:1 typical:1 common:1 class:1 status:1 actually:1 expects:1 expected:1 substantial:1 commercial:1 industrial:1 represent:1 significant:1 methods:1 procedures:1 authorization:1 keys:1 execute:1 suffice:1 continued:1 functioning:1 prevented:1 interfered:1 because:1 transferred:1 perpetuity:1 characterized:1 neither:1 nor:1 retains:1 ability:1 rom:1 updates:1 denied:1 itself:1 materially:1 adversely:1 affects:1 violates:1 rules:1 protocols:1 across:1 format:1 documented:1 password:1 key:1 unpacking:1 reading:1 treated:1 though:1 were:1 regard:1 own:1 removal:1 authorized:1 disclaiming:1 differently:1 preservation:1 attributions:1 displayed:1 containing:1 misrepresentation:1 origin:1 publicity:1 declining:1 trademark:1 trade:1 trademarks:1 marks:1 f:1 indemnification:1 considered:1 meaning:1 permits:1 survive:1 indicating:1 8:1 expressly:1 attempt:1 void:1 cease:1 provisionally:1 until:1 terminates:1 fails:1 notify:1 60:1 cessation:1 moreover:1 notifies:1 cure:1 30:1 receipt:1 terminated:1 qualify:1 9:1 ancillary:1 occurring:1 likewise:1 actions:1 propagating:1 indicate:1 automatic:1 licensing:1 subject:1 responsible:1 compliance:1 transferring:1 assets:1 subdividing:1 merging:1 results:1 whatever:1 had:1 plus:1 efforts:1 affirmed:1 initiate:1 litigation:1 cross:1 counterclaim:1 lawsuit:1 alleging:1 importing:1 owned:1 controlled:1 already:1 hereafter:1 sublicenses:1 exclusive:1 worldwide:1 sell:1 import:1 contents:1 paragraphs:1 denominated:1 covenant:1 sue:1 readily:1 accessible:1 deprive:1 yourself:1 benefit:1 actual:1 knowledge:1 identifiable:1 reason:1 believe:1 pursuant:1 procuring:1 conveyance:1 receiving:1 authorizing:1 extended:1 scope:1 prohibits:1 conditioned:1 business:1 distributing:1 payment:1 activity:1 primarily:1 compilations:1 contain:1 entered:1 was:1 28:1 march:1 construed:1 excluding:1 defenses:1 12:1 court:1 contradict:1 excuse:1 simultaneously:1 pertinent:1 agree:1 obligate:1 collect:1 whom:1 refrain:1 entirely:1 link:1 combine:1 concerning:1 combination:1 14:1 spirit:1 present:1 differ:1 detail:1 address:1 concerns:1 distinguishing:1 specify:1 ever:1 decide:1 result:1 choosing:1 expressed:1 risk:1 quality:1 performance:1 prove:1 defective:1 assume:1 servicing:1 repair:1 correction:1 event:1 agreed:1 incidental:1 consequential:1 arising:1 out:1 inability:1 loss:1 rendered:1 inaccurate:1 losses:1 sustained:1 failure:1 operate:1 advised:1 possibility:1 17:1 interpretation:1 effect:1 according:1 reviewing:1 courts:1 closely:1 approximates:1 absolute:1 waiver:1 civil:1 assumption:1 accompanies:1 return:1 end:1 develop:1 greatest:1 possible:1 best:1 achieve:1 safest:1 start:1 state:1 exclusion:1 pointer:1 full:1 found:1 brief:1 idea:1 distributed:1 hope:1 contact:1 electronic:1 paper:1 mail:1 terminal:1 short:1 starts:1 absolutely:1 welcome:1 hypothetical:1 course:1 might:1 gui:1 about:1 box:1 employer:1 programmer:1 school:1 sign:1 incorporating:1 subroutine:1 consider:1 linking:1 applications:1 lesser:1 instead:1 please:1 read:1 why:1 lgpl:1 html:1",
    "LGPL-3.0": "the:114 of:60 a:44 library:34 and:30 version:27 that:26 license:25 work:24 to:22 gnu:21 combined:21 you:20 is:18 by:17 with:16 this:15 for:15 application:14 or:14 in:13 public:12 general:11 code:11 copy:10 gpl:10 under:10 if:10 lesser:9 not:9 an:9 corresponding:9 may:9 3:8 it:8 terms:8 as:8 any:8 source:8 on:7 modified:7 use:6 are:6 object:6 convey:6 such:6 but:5 covered:5 based:5 linked:5 section:5 versions:5 b:5 do:5 following:5 information:5 free:4 software:4 foundation:4 document:4 refers:4 other:4 provided:4 data:4 from:4 4:4 your:4 facility:4 notice:4 each:4 accompany:4 6:4 copyright:3 additional:3 0:3 used:3 interface:3 minimal:3 1:3 conveying:3 be:3 part:3 its:3 material:3 form:3 choice:3 give:3 prominent:3 user:3 d:3 suitable:3 time:3 provide:3 installation:3 option:3 facilities:3 new:3 received:3 published:3 2007:2 c:2 copies:2 conditions:2 permissions:2 below:2 than:2 defined:2 which:2 otherwise:2 produced:2 linking:2 also:2 means:2 excluding:2 portions:2 system:2 libraries:2 modifications:2 function:2 uses:2 does:2 header:2 both:2 together:2 notices:2 one:2 manner:2 specified:2 mechanism:2 present:2 s:2 will:2 only:2 must:2 side:2 same:2 uncombined:2 revised:2 number:2 specifies:2 later:2 choose:2 proxy:2 29:1 june:1 inc:1 https:1 fsf:1 org:1 everyone:1 permitted:1 distribute:1 verbatim:1 changing:1 allowed:1 incorporates:1 supplemented:1 listed:1 definitions:1 herein:1 governed:1 makes:1 defining:1 subclass:1 class:1 deemed:1 mode:1 using:1 combining:1 particular:1 was:1 made:1 called:1 considered:1 isolation:1 including:1 utility:1 programs:1 needed:1 reproducing:1 exception:1 sections:1 without:1 being:1 bound:1 2:1 modify:1 supplied:1 argument:1 passed:1 when:1 invoked:1 then:1 make:1 good:1 faith:1 effort:1 ensure:1 event:1 supply:1 still:1 operates:1 performs:1 whatever:1 purpose:1 remains:1 meaningful:1 none:1 applicable:1 incorporating:1 files:1 incorporate:1 file:1 incorporated:1 limited:1 numerical:1 parameters:1 structure:1 layouts:1 accessors:1 small:1 macros:1 inline:1 functions:1 templates:1 ten:1 fewer:1 lines:1 length:1 works:1 taken:1 effectively:1 restrict:1 modification:1 contained:1 reverse:1 engineering:1 debugging:1 displays:1 during:1 execution:1 include:1 among:1 these:1 well:1 reference:1 directing:1 permit:1 recombine:1 relink:1 produce:1 shared:1 at:1 run:1 already:1 computer:1 operate:1 properly:1 compatible:1 e:1 would:1 required:1 extent:1 necessary:1 install:1 execute:1 recombining:1 relinking:1 5:1 place:1 single:1 applications:1 conveyed:1 explaining:1 where:1 find:1 accompanying:1 publish:1 similar:1 spirit:1 differ:1 detail:1 address:1 problems:1 concerns:1 given:1 distinguishing:1 certain:1 numbered:1 applies:1 have:1 either:1 specify:1 ever:1 can:1 decide:1 whether:1 future:1 shall:1 apply:1 statement:1 acceptance:1 permanent:1 authorization:1",
    "MPL-2.0": "the:130 of:115 license:69 or:67 to:62 a:55 you:50 this:49 any:44 software:39 covered:36 and:36 contributor:35 under:35 such:32 in:30 form:29 that:26 by:26 is:23 with:22 for:22 code:21 source:20 terms:20 means:18 be:18 version:17 if:17 not:17 may:16 rights:14 its:14 licenses:13 secondary:12 b:12 as:12 notice:11 work:11 section:11 patent:10 shall:10 from:9 your:9 distribute:9 granted:9 must:9 liability:9 contributions:8 s:8 other:8 claims:8 limitation:8 on:8 no:8 warranty:8 executable:7 including:7 file:7 all:7 an:7 except:7 it:7 public:6 each:6 entity:6 particular:6 modifications:6 incompatible:6 larger:6 grant:6 extent:6 either:6 2.1:6 versions:6 grants:6 use:6 have:6 distribution:6 comply:6 notices:6 mozilla:5 2.0:5 contribution:5 which:5 has:5 exhibit:5 than:5 new:5 without:5 non:5 are:5 additional:5 create:5 recipients:5 then:5 damages:5 legal:4 made:4 at:4 otherwise:4 more:4 make:4 basis:4 limitations:4 only:4 party:4 governed:4 alter:4 recipient:4 provided:4 one:4 regulation:4 some:4 termination:4 compliance:4 litigation:4 steward:4 combination:3 initial:3 attached:3 described:3 available:3 also:3 licensable:3 possible:3 whether:3 gnu:3 general:3 contract:3 ownership:3 conditions:3 part:3 offer:3 respect:3 become:3 will:3 above:3 necessary:3 3.4:3 subsequent:3 3.3:3 fair:3 copyright:3 3.1:3 they:3 can:3 obtain:3 copy:3 reasonable:3 so:3 support:3 indemnity:3 jurisdiction:3 statute:3 prior:3 against:3 disclaimer:3 law:3 modified:3 1.1:2 individual:2 creation:2 used:2 was:2 but:2 having:2 right:2 maximum:2 time:2 conveyed:2 claim:2 would:2 infringed:2 making:2 sale:2 import:2 transfer:2 control:2 direct:2 indirect:2 2:2 hereby:2 free:2 modify:2 effective:2 date:2 first:2 distributes:2 implied:2 does:2 requirements:2 result:2 choice:2 10.2:2 permitted:2 represents:2 limit:2 applicable:2 sections:2 3.2:2 inform:2 how:2 attempt:2 charge:2 cost:2 remove:2 disclaimers:2 choose:2 however:2 do:2 behalf:2 include:2 due:2 description:2 5.1:2 terminate:2 compliant:2 reinstated:2 ongoing:2 days:2 after:2 received:2 5.2:2 excluding:2 counter:2 cross:2 distributors:2 been:2 negligence:2 incidental:2 consequential:2 apply:2 exclusion:2 where:2 subject:2 provision:2 10.3:2 v:2 mpl:2 1:1 definitions:1 creates:1 contributes:1 owns:1 1.2:1 others:1 1.3:1 1.4:1 case:1 portions:1 thereof:1 1.5:1 earlier:1 1.6:1 1.7:1 combines:1 material:1 separate:1 files:1 1.8:1 document:1 1.9:1 subsequently:1 1.10:1 following:1 results:1 addition:1 deletion:1 modification:1 contents:1 contains:1 1.11:1 method:1 process:1 apparatus:1 using:1 selling:1 offering:1 1.12:1 lesser:1 affero:1 3.0:1 later:1 those:1 1.13:1 preferred:1 1.14:1 exercising:1 entities:1 includes:1 controls:1 controlled:1 common:1 purposes:1 definition:1 power:1 cause:1 direction:1 management:1 fifty:1 percent:1 50:1 outstanding:1 shares:1 beneficial:1 world:1 wide:1 royalty:1 exclusive:1 intellectual:1 property:1 trademark:1 reproduce:1 display:1 perform:1 exploit:1 unmodified:1 sell:1 2.2:1 2.3:1 scope:1 licensing:1 notwithstanding:1 removed:1 infringements:1 caused:1 i:1 third:1 ii:1 c:1 absence:1 trademarks:1 service:1 marks:1 logos:1 2.4:1 makes:1 see:1 2.5:1 representation:1 believes:1 original:1 sufficient:1 2.6:1 intended:1 doctrines:1 dealing:1 equivalents:1 2.7:1 3:1 responsibilities:1 contribute:1 restrict:1 timely:1 manner:1 sublicense:1 different:1 permits:1 additionally:1 their:1 option:1 further:1 substance:1 contained:1 within:1 required:1 remedy:1 known:1 factual:1 inaccuracies:1 3.5:1 application:1 fee:1 obligations:1 own:1 absolutely:1 clear:1 obligation:1 offered:1 alone:1 agree:1 indemnify:1 every:1 incurred:1 specific:1 4:1 inability:1 impossible:1 judicial:1 order:1 describe:1 affect:1 placed:1 text:1 included:1 distributions:1 prohibited:1 sufficiently:1 detailed:1 ordinary:1 skill:1 able:1 understand:1 5:1 automatically:1 fail:1 provisionally:1 unless:1 until:1 explicitly:1 finally:1 terminates:1 fails:1 notify:1 60:1 come:1 back:1 into:1 moreover:1 notifies:1 30:1 receipt:1 initiate:1 asserting:1 infringement:1 declaratory:1 judgment:1 actions:1 alleging:1 directly:1 indirectly:1 infringes:1 contributors:1 5.3:1 event:1 end:1 user:1 agreements:1 resellers:1 validly:1 survive:1 6:1 kind:1 expressed:1 statutory:1 warranties:1 defects:1 merchantable:1 fit:1 purpose:1 infringing:1 entire:1 risk:1 quality:1 performance:1 should:1 prove:1 defective:1 assume:1 servicing:1 repair:1 correction:1 constitutes:1 essential:1 authorized:1 7:1 circumstances:1 theory:1 tort:1 anyone:1 who:1 liable:1 special:1 character:1 lost:1 profits:1 loss:1 goodwill:1 stoppage:1 computer:1 failure:1 malfunction:1 commercial:1 losses:1 even:1 informed:1 possibility:1 death:1 personal:1 injury:1 resulting:1 prohibits:1 jurisdictions:1 allow:1 8:1 relating:1 brought:1 courts:1 defendant:1 maintains:1 principal:1 place:1 business:1 laws:1 reference:1 conflict:1 provisions:1 nothing:1 prevent:1 ability:1 bring:1 9:1 miscellaneous:1 complete:1 agreement:1 concerning:1 matter:1 hereof:1 held:1 unenforceable:1 reformed:1 enforceable:1 provides:1 language:1 construed:1 drafter:1 construe:1 10:1 10.1:1 foundation:1 publish:1 given:1 distinguishing:1 number:1 effect:1 originally:1 published:1 want:1 rename:1 references:1 name:1 note:1 differs:1 10.4:1 distributing:1 distributed:1 http:1 org:1 desirable:1 put:1 location:1 relevant:1 directory:1 likely:1 look:1 add:1 accurate:1 defined:1",
}
